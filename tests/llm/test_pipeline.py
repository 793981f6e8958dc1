import random
import zlib

import numpy as np

import corpus_pipeline
from stratalith.llm import decontaminate, packing

from .test_ngram_join import brute, variants
from .test_operators import EN, sentences


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = variants(rng, 12, 4, [40, 80, 120], 3)
    items = [(1, sentences(rng, [a + b for a in EN for b in EN], 30))]
    rows += [(9000, "12 34"), (9001, None), (9002, ""), (9003, sentences(rng, EN, 40) + " " + items[0][1])]
    rows += [(9010 + i, sentences(rng, EN, 30) + " " + " ".join(EN * 6) + " " + sentences(rng, EN, 30)) for i in range(4)]
    spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    component = brute(kept, 5, 80)
    kept = [(i, t) for i, t in kept if component[i][1] == i]
    cut = plain_kept(kept, 100)
    assert any(cut[i] != t for i, t in kept)
    encoder = packing.Encoder(packing.tokenizer_path()).tokenizer
    want = {}
    for i, _ in kept:
        if not decontaminate.plain(cut[i], items)[4]:
            ids = np.array([*encoder.encode(cut[i], add_special_tokens=False).ids, 0], "<u4")
            want |= {(i, k // 2048): (len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    assert {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in got} == want
    assert not {9000, 9001, 9002, 9003} & {i for i, _ in want}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "suffix_dedup", "decontaminate", "packing"]


def plain_kept(rows, length):
    """The texts without the bytes of strings that start earlier; characters that are cut in two go."""
    first, out = {}, {}
    for i, t in sorted(rows):
        raw = t.encode()
        covered = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first.setdefault(raw[s : s + length], (i, s)) != (i, s):
                covered[s : s + length] = b"\1" * length
        out[i] = bytes(b for b, c in zip(raw, covered, strict=True) if not c).decode("utf-8", "ignore") if any(covered) else t
    return out
