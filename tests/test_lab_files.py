import json

from pyspark.sql import functions as F

from stratalith.operators import damage
from stratalith.sources import archive, lab_files


def test_trees_records_and_reports(spark, tmp_path):
    (tmp_path / "t" / "b").mkdir(parents=True)
    (tmp_path / "t" / "b" / "x.txt").write_bytes(b"12345")
    (tmp_path / "t" / "a.txt").write_bytes(b"")
    assert [(r["relative_path"], r["size"]) for r in lab_files.tree(spark, f"file://{tmp_path}/t").collect()] == [("a.txt", 0), ("b/x.txt", 5)]
    assert lab_files.size_map(spark, f"{tmp_path}/t").columns == ["path", "bytes"]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "one.json").write_text(json.dumps([{"id": 1, "n": 5}, {"id": 2, "n": 6}], indent=1))
    (tmp_path / "runs" / "two.json").write_text(json.dumps({"id": 1, "n": 9}))
    runs = lab_files.json_records(spark, f"file://{tmp_path}/runs", "id long, n long")
    assert sorted(map(tuple, lab_files.latest_runs(runs, "id", "n").collect())) == [(1, 9), (2, 6)]
    lab_files.write_report(runs, f"file://{tmp_path}/report")
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "report").glob("part-*")) == 3
    lab_files.write_list(spark.createDataFrame([("b", 1), ("a", 2)], "path string, n int"), f"file://{tmp_path}/list", "path")
    assert "".join(p.read_text() for p in sorted((tmp_path / "list").glob("part-*"))) == "a\nb\n"
    lab_files.write_recovered(spark.createDataFrame([("canonical", "a", b"x"), ("unrecoverable", None, None)], "trust_class string, name string, data binary"), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/files").where("trust_class = 'canonical'").count() == 1
    assert spark.read.json(f"file://{tmp_path}/out/manifest").count() == 2


def test_raw_fields_keep_their_bytes(spark):
    rows = [('{"a": {"body": 1}, "body" : {"b": [1, 2],  "a": "}"} , "n": 1}',), ('{"n": 1}',), ("no json",), (None,), ('{"body":[ 1 , 2 ]}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(lab_files.raw_field(F.col("t"), "body")).collect()]
    assert got == ['{"b": [1, 2],  "a": "}"}', None, None, None, "[ 1 , 2 ]"]


def test_discovery_and_ranges(spark, tmp_path):
    files = spark.createDataFrame([("x", "a.txt", "regular", b"one two three"), ("x", "e.txt", "regular", b"")], "archive string, entry_path string, kind string, data binary")
    packed = archive.pack(files)
    (tmp_path / "x.arc").write_bytes(packed.first()["content"])
    (tmp_path / "noise.bin").write_bytes(b"nothing")
    (tmp_path / "empty").write_bytes(b"")
    assert [r["archive"][-5:] for r in archive.discover(spark, f"file://{tmp_path}").collect()] == ["x.arc"]
    data = packed.first()["content"]
    assert [archive.read_range(data, "a.txt", a, n) for a, n in ((0, 3), (4, 100), (99, 5), (0, 0))] == [b"one", b"two three", b"", b""]
    assert archive.read_range(data, "e.txt", 0, 5) == b""


def test_trained_dictionaries_compress(spark):
    import zstandard

    rows = [("words", i, f"a sample of words number {i} with common words in every sample {i % 7}".encode()) for i in range(1, 400)] + [("few", 1, b"x")]
    got = {r["cohort"]: r for r in archive.train_dictionaries(spark.createDataFrame(rows, "kind string, place int, body binary"), "kind", most=300, size=2048).collect()}
    assert got["words"]["samples"] == 300 and got["few"]["dictionary"] is None
    with_it = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(bytes(got["words"]["dictionary"])))
    assert len(with_it.compress(rows[350][2])) < len(zstandard.ZstdCompressor().compress(rows[350][2]))


def test_mutations_on_short_archives(spark):
    cases = [(str(n), kind, target, m, 1337, bytes(range(n))) for n in (0, 1, 2, 7, 40) for kind in ("bit_flip", "byte_overwrite", "zero_fill", "truncation", "tail_damage") for target in ("header", "index", "payload", "tail") for m in (1, 256)]
    rows = spark.createDataFrame([(f"{c[0]}/{c[1]}/{c[2]}/{c[3]}", *c[1:]) for c in cases], "name string, corruption_type string, target string, magnitude_bytes int, seed int, content binary")
    for r in damage.corrupt(rows, "name").collect():
        n, kind = int(r["key"].split("/")[0]), r["key"].split("/")[1]
        changed = [i for i, (a, b) in enumerate(zip(bytes(range(n)), r["content"], strict=False)) if a != b]
        if r["range_start"] is None:
            assert r["content"] == bytes(range(n)) and r["before"] == r["after"]
        else:
            assert all(r["range_start"] <= i < r["range_end"] for i in changed)
            assert len(r["content"]) == r["new_size"] == (r["range_start"] if kind == "truncation" else n)
