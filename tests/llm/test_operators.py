"""Small fixtures for the operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import re
import resource
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalith.llm import decontaminate, html_extract, language_id, masked_lm, ngram_join, packing, quality_fm, quality_rules, suffix_dedup, textkit, warc
from stratalith.llm.textstats import Stats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, word string"
ODD = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "é" * 5000), (None, "no id"), (9005, "word " * 30000)]


def frame(spark, rows, lang=lambda i: None):
    return spark.createDataFrame([(i, t, lang(i), "s", 0 if t is None else len(t), 1, "w") for i, t in rows], SCHEMA).repartition(2)


def sentences(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


EN = "the of and thing with that over house river under stone light".split()
DE = "der und nicht haus mit schön über fluss stein licht größer auf".split()


# 1 quality rules


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, hit, lines, dup = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set(), set(), 0
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_counts_equal_plain_ones():
    rng = random.Random(2)
    texts = [None, "", "\n\n", "a\nb\na\n", "x" * 300, "é|€ #😀\n" * 9] + ["".join(rng.choice("ab \n\t#é") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    s = Stats(pa.array(texts))
    got = list(zip(s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, strict=True))
    assert got == [plain_counts(t) for t in texts]
    assert np.isfinite(s.vectors()).all()


def test_base_counts_in_sql(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab \n\t#%") for _ in range(rng.randint(0, 300)))) for i in range(60)] + [(100, None), (101, ""), (102, "x " * 50)]
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality_rules.judge(frame(spark, rows)).collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = duck.sql(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        b AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
            FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id)
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words FROM b""").fetchall()
    assert got == {r[0]: tuple(r[1:]) for r in want}


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(5)
    vocabulary = [a + b for a in EN for b in EN]
    clean = [(i, " ".join(sentences(rng, vocabulary, rng.randint(4, 16)).capitalize() + rng.choice(".!?") for _ in range(rng.randint(5, 30)))) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "$$$&&&" for w in sentences(rng, vocabulary, 80).upper().split())) for i in range(6)]
    small = [(2000 + i, clean[i][1]) for i in range(3)] + [(2010, junk[0][1])]
    docs = frame(spark, clean + junk + ODD).unionByName(frame(spark, small).withColumn("source", F.lit("small")))
    out = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert sum(out[i]["kept"] for i, _ in clean) >= 297
    assert not any(out[i]["kept"] for i, _ in junk)
    assert [out[i]["kept"] for i, _ in small] == [True] * 3 + [False]  # few rows lean on the pooled estimate
    assert out[9001]["n_words"] == 0 and out[9001]["base_failed"] and not out[9001]["kept"]
    assert len(out) == len(clean) + len(junk) + len(ODD) + len(small)
    assert quality_rules.judge(frame(spark, [])).count() == 0
    assert quality_rules.judge(frame(spark, [(1, "few words"), (2, None)])).where("kept or distance is not null").count() == 0


def vectors(spark, x, key="k"):
    rows = [(i, key, "l", [float(v) for v in r], ((i * 2654435761) % (1 << 32)) / (1 << 32), False) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id long, key string, lkey string, x array<double>, u double, base_failed boolean").repartition(4)


def plain_mcd(x, h, starts=80):
    """The fast algorithm on one group, as published: random starts, concentration, least determinant, the median as consistency factor."""
    rng, best = np.random.default_rng(1), None
    for _ in range(starts):
        rows = x[rng.choice(len(x), x.shape[1] + 1, replace=False)]
        for _ in range(40):
            mu, cov = rows.mean(0), np.cov(rows.T, bias=True) + 1e-9 * np.eye(x.shape[1])
            near = np.argsort(quality_rules.squared(x, mu, np.linalg.inv(cov)), kind="stable")[:h]
            if set(map(tuple, x[near])) == set(map(tuple, rows)):
                break
            rows = x[near]
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mu, cov
    _, mu, cov = best
    d2 = quality_rules.squared(x, mu, np.linalg.inv(cov))
    return mu, cov, np.median(d2) / quality_rules.quantile(0.5, x.shape[1])


def correlated(rng, n, p):
    a = rng.normal(size=(p, p))
    clean = rng.normal(size=(n, p)) @ a
    bad = rng.normal(size=(n // 6, p)) * 0.3 + 12 * a[0] * np.array([1, -1] * (p // 2))
    return np.concatenate([clean, bad])


def test_estimate_equals_a_plain_fast_mcd(spark):
    x = correlated(np.random.default_rng(4), 4000, len(quality_rules.PROFILE))
    found, groups = quality_rules.estimate(vectors(spark, x))
    r = found.first()
    mu, cov, scale = plain_mcd(x[:: len(x) // 1500], round(0.75 * len(x[:: len(x) // 1500])))
    mu, cov, scale = plain_mcd(x, quality_rules._covered(len(x)), 12)
    mine = quality_rules.squared(x, np.array(r["mu"]), np.linalg.inv(np.array(r["cov"]).reshape(cov.shape))) / r["scale"]
    theirs = quality_rules.squared(x, mu, np.linalg.inv(cov)) / scale
    cutoff = quality_rules.quantile(1e-6)
    assert groups == 1 and ((mine > cutoff) == (theirs > cutoff)).mean() > 0.999
    assert np.abs(np.log(mine / theirs)).mean() < 0.1
    assert (mine[4000:] > cutoff).all() and (mine[:4000] <= cutoff).mean() > 0.999


def test_starts_rest_on_all_rows(spark):
    rng, p = np.random.default_rng(8), len(quality_rules.PROFILE)
    clean, bad = rng.normal(size=(3000, p)), 9 + 0.1 * rng.normal(size=(800, p))
    docs = vectors(spark, np.concatenate([bad, clean]))
    # any draw by the least u would hold bad rows alone
    r = quality_rules.estimate(docs.withColumn("u", F.when(F.col("doc_id") < 800, F.col("u") / 2).otherwise(0.5 + F.col("u") / 2)))[0].first()
    distance = lambda x: quality_rules.squared(x, np.array(r["mu"]), np.linalg.inv(np.array(r["cov"]).reshape(p, p))) / r["scale"]
    cutoff = quality_rules.quantile(quality_rules.LEVEL)
    assert (distance(clean) <= cutoff).all() and (distance(bad) > cutoff).all()
    assert np.abs(np.array(r["mu"])).max() < 0.2
    counts = np.array([[1.0, 0, 2, 1], [4, 0, 0, 0]])
    assert quality_rules.quartiles(counts, np.array([0.0, 5]), np.array([4.0, 5])).tolist() == [[1.0, 5.0], [2.5, 5.0], [3.0, 5.0]]


def test_covariances_decide(spark):
    rng = np.random.default_rng(6)
    p = len(quality_rules.PROFILE)
    x = rng.normal(size=(600, p))
    x[:, 1] = x[:, 0] + 0.05 * x[:, 1]
    x[0, :2] = 1.5, -1.5  # ordinary in each statistic, but not together
    r = quality_rules.estimate(vectors(spark, x))[0].first()
    cov = np.array(r["cov"]).reshape(p, p)
    whole, diagonal = (quality_rules.squared(x, np.array(r["mu"]), np.linalg.inv(c)) / r["scale"] for c in (cov, np.diag(np.diag(cov))))
    cutoff = quality_rules.quantile(quality_rules.LEVEL)
    assert whole[0] > cutoff > diagonal[0] and (whole[1:] <= cutoff).all()


def test_quantiles_and_many_groups(spark, monkeypatch):
    assert math.isclose(quality_rules.quantile(0.05, 2), 5.9915, rel_tol=1e-4) and math.isclose(quality_rules.quantile(0.5, 6), 5.3481, rel_tol=1e-4)
    rng = random.Random(5)
    rows = [(i, sentences(rng, [a + b for a in EN for b in EN], rng.randint(40, 200))) for i in range(120)]
    docs = frame(spark, rows).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")))
    sent = {r["doc_id"]: r["distance"] for r in quality_rules.judge(docs).collect()}
    monkeypatch.setattr(quality_rules, "MOST_SENT", 3)
    salted = {r["doc_id"]: r["distance"] for r in quality_rules.judge(docs.repartition(7)).collect()}
    assert sent.keys() == salted.keys() and all(math.isclose(sent[i], salted[i], rel_tol=1e-6) for i in sent)


# 2 suffix dedup


def plain_dedup(rows, length):
    first, out = {}, {}
    for i, t in sorted((r for r in set(rows) if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first.setdefault(raw[s : s + length], (i, s)) != (i, s):
                covered[s : s + length] = b"\1" * length
        spans = sum(1 for k in range(len(covered)) if covered[k] and (not k or not covered[k - 1]))
        out[i] = (len(raw), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(raw, covered, strict=True) if not c)).hexdigest())
    return out


def mixed_texts(rng):
    passages = [sentences(rng, [a + b for a in EN + DE for b in EN], rng.randint(20, 60)) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.5 else sentences(rng, [a + b for a in EN for b in DE], 15) for _ in range(rng.randint(1, 5))]
        text = " ".join(parts)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice("xyzé") + text[k + 1 :]
        rows.append((i * 7 % 90 + 1, text))
    return rows


@pytest.mark.parametrize(("most", "hot"), [(100_000, 16), (3, 16), (100_000, 2), (3, 2), (3, 10**9)])
def test_dedup_equals_brute_force(spark, most, hot):
    rows = mixed_texts(random.Random(3)) + [(500, "ab" * 400), (501, "é" * 300), (502, "ab" * 60), (503, None), (504, ""), (505, "z" * 99), (506, "z" * 100), (507, "z" * 101)]
    rows += [(508, "same text " * 20), (508, "same text " * 20)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.report(frame(spark, rows), most=most, hot=hot).collect()}
    assert got == plain_dedup(rows, 100)


def test_merge_of_shards_does_not_depend_on_the_shards():
    rng = np.random.default_rng(1)
    columns = rng.integers(0, 2, (30, 200), dtype=np.uint8)
    rank = np.arange(200, dtype=np.int32)
    want = None
    for shards in (1, 2, 7):
        steps = suffix_dedup.merge(columns, rng.integers(0, shards, 200).astype(np.uint16), rank, 6, 24)
        want = steps if want is None else want
        assert (steps == want).all()
    for row in range(200):
        for begin in range(25):
            late = (columns[begin : begin + 6, :row] == columns[begin : begin + 6, row : row + 1]).all(0).any()
            assert late == (want[begin, row] == 1 or (want[: begin + 1, row].sum() == 1 and want[begin, row] == 0)) or begin > 0


def test_remove_keeps_columns_and_whole_characters(spark):
    # every 100-byte string of a run of one character but the first starts earlier in the run itself
    rows = [(1, "é" * 100), (2, "x" + "é" * 100 + "tail"), (None, "é" * 100), (3, None)]
    out = suffix_dedup.remove(frame(spark, rows))
    assert out.columns == SCHEMA.replace("long", "").replace("string", "").replace(" ", "").split(",")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: ("é", 1), 2: ("xtail", 5), None: ("é" * 100, 100), 3: (None, 0)}
    assert suffix_dedup.report(frame(spark, [])).count() == 0


# 3 packing


def test_packing_is_whole_gapless_and_as_good_as_plain_best_fit(spark):
    rng = random.Random(6)
    rows = [(i, sentences(rng, EN + DE, rng.randint(0, 900))) for i in range(80)] + ODD + [(7, "again"), (7, "again")]
    out = packing.pack(frame(spark, rows), capacity=256).collect()
    t = packing.Encoder(packing.tokenizer_path()).tokenizer
    want = collections.Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 256):
            want[(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(frame(spark, [])).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(100):
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 200))]
        room: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in room if r >= n]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else capacity) - n)
        used = collections.Counter()
        for n, _, count, first, each, _ in packing.plan(collections.Counter(lengths), capacity):
            for i in range(count):
                used[first + i // each] += n
        assert sorted(capacity - v for v in used.values()) == sorted(room)


# 5 language identification


def test_languages_spans_and_odd_texts(spark):
    rng = random.Random(7)
    rows = [(i, sentences(rng, EN if i % 2 else DE, 40)) for i in range(200)]
    docs = frame(spark, rows + ODD + [(9100, "12 34 !!"), (9101, "×÷")], lambda i: None if i is None or i > 8000 else ("en" if i % 2 else "de"))
    out = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(out[i]["lang_pred"] == ("en" if i % 2 else "de") for i, _ in rows)
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert [out[i]["lang_pred"] for i in (9001, 9002, 9003, 9100, 9101)] == ["und"] * 5
    assert all(0 <= r["score"] <= 1 for r in out.values())
    model = language_id.fit(docs)
    mixed = language_id.predict(frame(spark, [(1, sentences(rng, EN, 30) + " " + sentences(rng, DE, 30))]), model).first()
    assert [s["lang"] for s in mixed["spans"]] == ["en", "de"] and abs(mixed["spans"][1]["first_word"] - 30) <= 1
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} | {9004, 9005, None}
    assert language_id.identify(frame(spark, [])).count() == 0


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = rng.integers(0, 6, 4)
        scores = rng.normal(0, 2, (int(counts.sum()), 3))
        label = language_id._viterbi(scores.copy(), counts, 1.5)
        at = 0
        for n in counts.tolist():
            best = max((sum(scores[at + i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False)) for path in product(range(3), repeat=n)), default=0)
            path = label[at : at + n].tolist()
            assert math.isclose(best, sum(scores[at + i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False)), abs_tol=1e-9)
            at += n


# 6 decontamination


def test_decontamination_equals_plain_search(spark):
    rng = random.Random(8)
    items = [(i, sentences(rng, EN + DE, rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(20, None), (21, "  "), (22, "The, OF. and")]
    rows = []
    for i in range(60):
        words = sentences(rng, [a + b for a in EN for b in DE], 20).split()
        if rng.random() < 0.6:
            k = rng.randrange(len(words))
            words[k:k] = (rng.choice(items)[1] or "").split()[: rng.choice([5, 10, 40])]
        rows.append((i, " ".join(words)))
    rows += ODD[:4]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words long")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.hits(frame(spark, rows), bench, block_words=30)).collect()}
    assert got == {i: decontaminate.plain(t, items) for i, t in rows}
    kept = decontaminate.remove_contaminated(frame(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in rows if not decontaminate.plain(t, items)[4]}
    assert decontaminate.hits(frame(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


# 8 html extraction


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div>{body}{extra}<footer>&copy; host</footer></body></html>'


def test_extraction_with_and_without_article(spark):
    rows = [(i, "http://a.example/x", page(f"<article><h1>T {i}</h1><p>One  &amp;\n two {i}</p><p><b>Bold {i}<br><p>Last<aside>side</aside></article>")) for i in range(6)]
    rows += [(100 + i, "http://b.example/y", page(f'<div class="wrap"><p>Alpha beta gamma delta {i} epsilon</p><p>Zeta eta theta {i}</p><div class="comments"><p>Reader says {i}</p></div><form><p>Sign up</p></form></div>')) for i in range(6)]
    rows += [(200, None, None), (201, "http://c.example", ""), (202, "http://c.example", "plain <b>text</b> &lt;x"), (203, "http://c.example", "<article><p>cut <!-- open")]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, text string").repartition(2)
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert [got[i]["text"] for i in range(6)] == [f"T {i}\n\nOne & two {i}\n\nBold {i}\n\nLast" for i in range(6)]
    assert [got[100 + i]["text"] for i in range(6)] == [f"Alpha beta gamma delta {i} epsilon\n\nZeta eta theta {i}" for i in range(6)]
    assert [got[i]["text"] for i in (200, 201, 202, 203)] == ["", "", "plain text <x", "cut"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_template_does_not_depend_on_how_pages_are_dealt(spark):
    has = [True] * 10 + [True, True, False, False, False] + [True, False, False, False, False]  # 65 % of the pages, by tasks 5, 5, 2 and 1 of 5
    rows = [(i, "http://d.example/", f'<html><body><div class="top"><p>Line {i}</p></div>' + (f'<div class="content"><p>Alpha beta gamma {i}</p></div>' if h else "") + "</body></html>") for i, h in enumerate(has)]
    schema = "page_id long, url string, html string"
    uneven = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), schema)
    texts = [{r["page_id"]: r["text"] for r in html_extract.extract(p).collect()} for p in (uneven, uneven.coalesce(1))]
    assert texts[0] == texts[1] == {i: f"Alpha beta gamma {i}" if h else f"Line {i}" for i, h in enumerate(has)}


def test_constant_text_under_a_neutral_class_goes(spark):
    long = " ".join(f"notice{k}" for k in range(30))
    same = f'<div class="x1"><p>Join our letter</p><span>Home</span><span>Other pages</span></div><div>{long}</div>'
    rows = [(i, "http://e.example/", f"<html><body><article><p>Story {i} told</p>{same}<p>More of {i}</p></article></body></html>") for i in range(8)]
    rows += [(100 + i, "http://f.example/", f"<html><body>{same}<table><tr><td>Cell {i}</td></tr></table></body></html>") for i in range(8)]
    rows += [(200 + i, "http://g.example/", "<html><body><article><p>Only copies</p></article></body></html>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} told\n\nMore of {i}" for i in range(8)} | {100 + i: f"Cell {i}" for i in range(8)} | {200 + i: "Only copies" for i in range(8)}


def generated_hosts(rng, n_hosts=20):
    """Hosts without article elements: a layout of constant and changing parts, and what of it is main text."""
    rows, want = [], {}
    for h in range(n_hosts):
        tags = [rng.choice(["div", "section", "td", "span"]) for _ in range(6)]
        fixed = [sentences(rng, [a + b for a in EN for b in DE], rng.choice([1, 3, 9, 25])) for _ in range(5)]
        names = [f"z{rng.randrange(10**6)}" for _ in range(4)]
        for p in range(8):
            paragraphs = [f"{sentences(rng, [a + b for a in EN for b in EN], rng.randint(8, 30))} {h} {p} {k}" for k in range(rng.randint(2, 5))]
            label = f"Written {p} in {h}"
            body = "".join(f"<p>{x}</p>" for x in paragraphs)
            html = f"<html><body><div class={names[0]}><b>{fixed[0]}</b><i>{fixed[1]}</i></div><div class='{names[1]}'><h1>{label}</h1><div id={names[2]}>{fixed[2]}</div>{body}<div class={names[3]}><em>{fixed[3]}</em></div></div><div><{tags[0]}>{fixed[4]}</{tags[0]}></div></body></html>"
            rows.append((h * 100 + p, f"https://h{h}.example/{p}", html))
            want[h * 100 + p] = "\n\n".join([label, *paragraphs])
    return rows, want


def test_generated_hosts_without_articles(spark):
    rows, want = generated_hosts(random.Random(9))
    schema = "page_id long, url string, html string"
    one, many = spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame(rows, schema).repartition(16)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(one).collect()}
    assert got == want
    assert got == {r["page_id"]: r["text"] for r in html_extract.extract(many).collect()}
    parser = html_extract.Parser()  # without templates the constant parts stay
    assert all("\n\n".join(html_extract.blocks(parser, t, None, frozenset())) != want[i] for i, _, t in rows)


def test_many_templates_are_joined_to_the_pages(spark, monkeypatch):
    from stratalith.llm import skew

    rows, want = generated_hosts(random.Random(4), 6)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(html_extract, "MOST_SENT", 2)
    monkeypatch.setattr(skew, "FEW_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == want


def test_tokens_out_of_order_are_no_template(spark):
    one, two = "<h2>North wind</h2>", "<h3>South sea</h3>"
    rows = [(i, "http://o.example/", f"<html><body><div>{two + one if i % 2 else one + two}<p>Page number {i}</p><p>Told {i} so</p></div></body></html>") for i in range(8)]
    steady = [(100 + i, "http://q.example/", f"<html><body><div>{one}{two}<p>Page number {i}</p><p>Told {i} so</p></div></body></html>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows + steady, "page_id long, url string, html string")).collect()}
    assert all("South sea" in got[i] and "North wind" in got[i] and got[i].endswith(f"Page number {i}\n\nTold {i} so") for i in range(8))
    assert [got[100 + i] for i in range(8)] == [f"Page number {i}\n\nTold {i} so" for i in range(8)]
    assert html_extract.out_of_order({1: [1, 5], 2: [2, 6], 3: [3, 7]}, [1, 2, 3]) == []
    assert html_extract.out_of_order({1: [1, 3], 2: [2, 6], 3: [4, 7]}, [1, 2, 3]) == [3]


def test_quotes_depth_and_names(spark):
    parser = html_extract.Parser()
    text = lambda html: "\n\n".join(html_extract.blocks(parser, html, None, frozenset()))
    assert text("<p title=it's>one</p><p title=\"a > b\">two</p><p title='x>three</p><p>four</p>") == "one\n\ntwo\n\nthree\n\nfour"
    article = '<article><section id="related-work"><p>Related work</p></section><div class="search-algorithms">Search</div><div class="comment-list">said</div><div class="share buttons">share</div><div class="ad-banner">buy</div></article>'
    assert text(article) == "Related work\n\nSearch"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert text("<div>" * 20_000 + "deep" + "</i>" * 20_000) == "deep"
    html_extract.occurrences(parser, "<b>" * 20_000 + "deep <p>x")
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


# 9 factorisation machine


def test_pairwise_identity():
    rng = np.random.default_rng(2)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.BUCKETS + quality_fm._DENSE), rng.normal(size=(quality_fm.BUCKETS + quality_fm._DENSE, quality_fm.RANK)))
    at, ids, x = quality_fm.inputs(pa.array(["a b c a", None]))
    for r in range(2):
        i, v = ids[at[r] : at[r + 1]], x[at[r] : at[r + 1]].astype(float)
        want = 0.3 + (m.w[i] * v).sum() + sum(m.v[i[a]] @ m.v[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert math.isclose(m.margin(at, ids, x)[0][r], want, rel_tol=1e-5)


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(11)
    rows = [(i, sentences(rng, EN, 60) if i % 4 else " ".join(w.upper() + "###" for w in sentences(rng, EN, 60).split())) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_fm.classify(frame(spark, rows + ODD), labels).collect()}
    held = [i for i, _ in rows if out[i]["held_out"]]
    assert sum(out[i]["predicted"] == int(i % 4 > 0) for i in held) >= 0.95 * len(held)
    assert len(out) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in out.values())
    assert quality_fm.classify(frame(spark, rows), labels.limit(0)).where("score <> 0.5").count() == 0
    assert quality_fm.classify(frame(spark, []), labels).count() == 0


# 10 masked pseudo-likelihood


def test_scores_equal_a_plain_loop_and_order_matters(spark):
    rng = random.Random(12)
    pairs = [f"{a} {b}" for a, b in zip(EN, DE, strict=True)]
    rows = [(i, " ".join(rng.choice(pairs) for _ in range(60))) for i in range(300)]
    encoded = masked_lm.encode(frame(spark, rows))
    network, corpus = masked_lm.fit(encoded, masked=1.0)
    score = lambda r: {x["doc_id"]: x for x in masked_lm.score(masked_lm.encode(frame(spark, r)), network, corpus).collect()}
    out = score(rows[:5] + ODD)
    for i, text in rows[:2]:
        ids = masked_lm.tokens(pa.array([text]))[0].tolist()
        total = 0.0
        for k, x in enumerate(ids):
            s = network.bias.astype(float).copy()
            for j, d in enumerate(masked_lm._OFFSETS):
                s += network.embed[ids[k + d] if 0 <= k + d < len(ids) else masked_lm.VOCABULARY] * network.place[j]
            h = np.tanh(s)
            z = h @ network.out + network.prior
            total += z[corpus.klass[x]] - np.log(np.exp(z).sum())
            if corpus.klass[x] >= masked_lm.OWN:
                y = h @ network.inner[corpus.klass[x] - masked_lm.OWN] + network.tilt[corpus.klass[x] - masked_lm.OWN]
                total += y[corpus.slot[x]] - np.log(np.exp(y).sum())
        assert math.isclose(out[i]["log_likelihood"], total, rel_tol=1e-3)
    assert out[9001]["n_tokens"] == 0 and out[9001]["log_likelihood"] == 0 and out[9001]["mean_log_likelihood"] is None
    shuffled = [(i, " ".join(rng.sample(t.split(), 120))) for i, t in rows[:30]]
    mean = lambda r: np.mean([x["mean_log_likelihood"] for x in score(r).values()])
    assert mean(rows[:30]) > mean(shuffled) + 0.1
    assert masked_lm.pseudo_likelihood(frame(spark, [])).count() == 0


def test_training_does_not_depend_on_partitions_and_probabilities_sum_to_one(spark):
    rng = random.Random(3)
    left, right = [f"left{a}{b}" for a in EN for b in DE[:6]], [f"right{a}{b}" for a in EN for b in DE[:6]]
    rows = [(i, " ".join(f"{left[k]} {right[k]}" for k in (rng.randrange(72) for _ in range(60)))) for i in range(400)]
    docs = frame(spark, rows)
    # three shards, whatever the partitions
    fits = [masked_lm.fit(masked_lm.encode(d), masked=0.5, shard_tokens=15_000) for d in (docs.coalesce(1), docs.repartition(5))]
    assert (fits[0][0].flat == fits[1][0].flat).all()
    network, corpus = masked_lm.fit(masked_lm.encode(docs), masked=1.0, rounds=6)
    one = lambda w: int(masked_lm.tokens(pa.array([w]))[0][0])
    edge, gains = masked_lm.VOCABULARY, []
    every = np.arange(masked_lm.VOCABULARY)
    for k in range(0, 72, 5):  # context tells words of one class apart
        near = np.array([[edge, one(left[k]), edge, edge]], np.int32)
        p = network.log_probability(np.repeat(near, len(every), 0), every, corpus)
        assert math.isclose(np.exp(p).sum(), 1, rel_tol=1e-3)
        same = [x for x in map(one, right) if x != one(right[k])]
        gains += [p[one(right[k])] - p[x] for x in same]
    assert np.mean(gains) > 0.5


def test_every_document_is_masked(spark):
    words = [a + b for a in EN for b in DE]
    rows = [(i, " ".join(words[7 * i : 7 * i + 7] * 8)) for i in range(20)]  # no word stands in two documents
    network, corpus = masked_lm.fit(masked_lm.encode(frame(spark, rows)))
    for _, text in rows:
        ids = masked_lm.tokens(pa.array([text]))[0]
        assert network.embed[ids].any(1).all()
    unknown = masked_lm.tokens(pa.array(["zzzz never seen"]))[0]
    assert not network.embed[unknown].any()


def test_fingerprints_are_of_the_bytes_alone():
    data = np.frombuffer(b"abcabcab" + b"q" * 70_000 + b"abc" + b"q" * 70_000, np.uint8)
    p = textkit.Bytes(data)
    a = p.span(np.array([0, 3, 70_008, 8, 70_011, 8, 8]), np.array([3, 6, 70_011, 70_008, 140_011, 600, 601]))
    assert a[0] == a[1] == a[2] and a[3] == a[4] and len(set(a.tolist())) == 4
    for k in (3, 8, 24, 100):
        at = np.arange(200)
        assert (p.windows(k)[:200] == p.span(at, at + k)).all()


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_thue_morse_words_and_texts_are_told_apart(spark):
    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    p = textkit.Bytes(np.frombuffer((one + two).encode(), np.uint8))
    assert len(set(p.span(np.array([0, 2048]), np.array([2048, 4096])).tolist())) == 2
    words = [" ".join(x + "z" for x in t) for t in (one, two)]
    rows = [(1, one), (2, two), (3, one + " " + two), (4, words[0]), (5, words[1])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.report(frame(spark, rows)).collect()}
    assert got == plain_dedup(rows, 100)
    t = packing.Encoder(packing.tokenizer_path()).tokenizer
    out = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.pack(frame(spark, rows)).collect()}
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert all(out[i, k // 2048] == zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048))
    items = [(1, one), (2, " ".join(words[0].split()[:700]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.hits(frame(spark, rows), bench)).collect()}
    assert got == {i: decontaminate.plain(t, items) for i, t in rows}
    assert [r["component_id"] for r in ngram_join.join(frame(spark, [(1, one), (2, two), (3, f"{one} x y"), (4, f"{two} x y")])).orderBy("doc_id").collect()] == [1, 2, 3, 4]


CLASHING = ["doc", "_doc", "runs", "_text", "_id", "_y", "_hit", "_gone", "gone", "_und", "c0", "c1", "h1", "_h1", "n", "s1", "_n", "_c", "bucket", "x", "key", "d2", "mu", "pkey", "host", "rows", "words", "length", "_rank", "node", "component", "score", "held_out"]


def test_extra_columns_may_have_any_name(spark):
    rng = random.Random(4)
    rows = [(i, sentences(rng, EN if i % 2 else DE, 60)) for i in range(40)] + [(50, None), (None, "the of and"), (51, "12")]
    items = spark.createDataFrame([(1, rows[3][1], *range(len(CLASHING)))], ["item_id", "text", *CLASHING])
    docs = spark.createDataFrame([(i, t, "en" if i and i % 2 else "de", "s", len(t or ""), *range(len(CLASHING))) for i, t in rows], ["doc_id", "text", "lang", "source", "n_chars", *CLASHING])
    labels = spark.createDataFrame([(i, i % 2, *range(len(CLASHING))) for i in range(40)], ["doc_id", "quality", *CLASHING])
    for out in (quality_rules.judge(docs), suffix_dedup.report(docs), packing.pack(docs), language_id.identify(docs), decontaminate.hits(docs, items), ngram_join.join(docs), quality_fm.classify(docs, labels), masked_lm.pseudo_likelihood(docs)):
        got = out.collect()
        assert {r["doc_id"] for r in got} == {i for i, _ in rows}
        assert not {"held_out"} & set(out.columns) or all(r["held_out"] is not None for r in got)
    for out, gone in ((suffix_dedup.remove(docs), set()), (language_id.keep_identified(docs), {50, 51}), (decontaminate.remove_contaminated(docs, items), {3}), (ngram_join.keep_one(docs), set())):
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert {r["doc_id"] for r in got} == {i for i, _ in rows} - gone
        assert all(r[c] == k for r in got for k, c in enumerate(CLASHING))
    pages = spark.createDataFrame([(i, "http://a.example/", f"<p>text {i}</p>", *range(len(CLASHING))) for i in range(6)], ["page_id", "url", "html", *CLASHING])
    assert html_extract.extract(pages).count() == warc.archive(pages).count() == 6


def test_filters_judge_rows_by_their_own_text(spark):
    rows = [(1, "the of and thing"), (1, "12"), (None, "34"), (None, "with that over house")]
    docs = frame(spark, rows, lambda i: "en")
    assert sorted(r["text"] for r in language_id.keep_identified(docs).collect()) == ["the of and thing", "with that over house"]
    bench = spark.createDataFrame([(1, "of and"), (2, "that over")], "item_id long, text string")
    assert sorted(r["text"] for r in decontaminate.remove_contaminated(docs, bench, block_words=1).collect()) == ["12", "34"]


def test_more_languages_than_a_byte_holds(spark):
    names = [f"l{k:03}" for k in range(300)]
    rows = [(k * 3 + j, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}q{w}x" for w in "abcdefgh")) for k in range(300) for j in range(3)]
    docs = frame(spark, rows, lambda i: names[i // 3])
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert sum(out[i] == names[i // 3] for i, _ in rows) > 0.95 * len(rows)
