import random
import re

import pyarrow as pa
import pytest

from stratalith.llm import components, ngram_join as ng, skew


def sets_of(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def brute(rows, words, percent):
    sets = {i: sets_of(t, words) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n * 100 >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def run(spark, rows, words, percent, **how):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, doc string").repartition(3)
    out = ng.join(docs, words, percent, **how).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None}


def variants(rng, groups, copies, words, edits):
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(words))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent", "edits"), [(3, 90, 4), (5, 80, 5)])
def test_components_equal_brute_force(spark, words, percent, edits):
    rows = variants(random.Random(4), 25, 6, [4, 12, 30, 60, 120, 200], edits)
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "ONE"), (9006, "one two"), (9007, "one two"), (9007, "one two"), (None, "one")]
    assert run(spark, rows, words, percent) == brute(rows, words, percent)


@pytest.mark.parametrize("how", [{"hot": 2}, {"hot": 2, "most": 3}, {"most": 3}])
def test_hot_signatures_lose_no_link(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "FEW_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rows = variants(random.Random(5), 12, 14, [4, 12, 30, 60, 120], 4)
    rows += [(9000 + i, " ".join(f"v{k}" for k in range(40))) for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert run(spark, rows, 3, 90, **how) == brute(rows, 3, 90)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_salted_joins_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(200)], "a long, b long")
    other = spark.createDataFrame([(i, str(i)) for i in range(0, 200, 6)], "k long, x string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = rows.join(other, rows.a == other.k, how)
        want = want if "left_" in how else want.drop("k")
        got = skew.join(rows, other, {"a": "k"}, how)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_hot_group_is_checked_exhaustively_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ng, "BLOCK", 8)
    rows = variants(random.Random(8), 1, 120, [90], 12)
    assert run(spark, rows, 3, 80) == brute(rows, 3, 80)


def test_chain_of_links(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 120])) for i in range(25)]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_empty_table(spark):
    assert run(spark, [], 3, 90) == {}


def test_similar_sets_share_a_signature():
    rng = random.Random(1)
    for percent in (80, 90):
        for _ in range(300):
            n = rng.randint(1, 300)
            a = [rng.getrandbits(64) for _ in range(n)]
            b = list(a)
            for _ in range(rng.randint(0, n // 8 + 1)):
                if b:
                    b.pop(rng.randrange(len(b)))
                if rng.random() < 0.7:
                    b.append(rng.getrandbits(64))
            same = len(set(a) & set(b))
            if not b or same * 100 < percent * len(set(a) | set(b)):
                continue
            import numpy as np

            sets = [np.sort(np.array(x, np.uint64)) for x in (a, b)]
            sigs, cuts = ng.signatures(np.concatenate(sets), np.cumsum([0, len(a), len(b)]), percent)
            assert set(sigs[: cuts[1]].tolist()) & set(sigs[cuts[1] :].tolist())


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_shingles_of_short_texts():
    grams, cuts = ng.shingles(pa.array(["a b", None, "a b c", "A B C"]), 3)
    assert cuts.tolist() == [0, 1, 1, 2, 3] and grams[1] == grams[2]
