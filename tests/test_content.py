"""Contents against DuckDB, on texts that begin with a JSON value but are none."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalith.operators import content
from stratalith.plans import registry

# a card number or another value first, then words; the second is mostly not ASCII
TEXTS = ["4355709550244650 Mentoi un viè", "4 èèèèèèèèèèè", "12abc", "1 2", "true false", '"a" b', "[1]x", '{"a":1} {"a":2}', "1],[2", '1},{"v":2', "1}", "1]", "1,2", '1,"v":2', "1,", "-", "2026-11-28", "01", "", " ", "null",
    "17", " -1.5e3\n", '"a"', "[1, {}]", '{"a":[null, true]}', '{"a":1,"a":2}', '["\\ud83d\\ude00", "\\\\ud83d"]', '"\\ud83d"', '["\\ude00"]', "<a></a>", "<html", "9" * 3000]


def test_whole_text_is_json(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = dict(rows.select("t", content.is_json(F.col("t"))).collect())
    assert got == dict(duckdb.connect().execute("SELECT t, json_valid(t) FROM (SELECT unnest(?) AS t)", [TEXTS]).fetchall())
    assert not spark.range(1).select(content.is_json(F.lit(None).cast("string"))).first()[0]


def agrees(spark, folder, name):
    """A query over documents of TEXTS and null equals its SQL."""
    c, d = duckdb.connect(), str(folder)
    c.execute("CREATE TABLE documents AS SELECT CAST(unnest(range(?)) AS BIGINT) AS doc_id, unnest(?) AS text", [len(TEXTS) + 1, [*TEXTS, None]])
    c.sql("CREATE TABLE pages AS SELECT doc_id AS page_id, text AS html FROM documents WHERE false")
    c.sql("CREATE TABLE events AS SELECT doc_id AS event_id, text AS props FROM documents WHERE false")
    for t in ("documents", "pages", "events"):
        c.sql(f"COPY {t} TO '{d}/{t}.parquet'")
    got = registry.queries()[name](spark, d)
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert len(want) == len(TEXTS) + 1 and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["f22_content_kinds", "f22_html_first", "f24_assigned_names"])
def test_kinds_equal_sql(spark, tmp_path, name):
    agrees(spark, tmp_path, name)


# texts on which the reference's classifier and the SQL part: JSON that only DuckDB takes, odd white space, signatures of binary formats
ODD = ["NaN", "-nan", "inf", " -Infinity\n", "iNf", "[1,]", '{"a":1 ,\n}', '["a,]", [NaN,], {"k":-inf,},]', "[" * 3000 + "]" * 3000, '{"a":' * 2000 + "1" + "}" * 2000,
    "[,]", "{ , }", "[1,,]", '{"a":,}', "1,", "nano", "1nan", "+inf", "{NaN:1}", '"[1,]', '["a\\q",]', '["a\nb",]', '["\\ud83d",]', '["\\u0041\\"",]', '"\\\\",', "1,2,", '1,"w":1', '1,"w":1}', '1],"w":1,"v":[2', "[1,}", "\\n1", '"\\n"', "\x00", "1\x00",
    "\x0b<a></a>", "\x0c<?xml", "\r\n\t <a></a>", " <a></a>", "BMW", "ID3 tag", "%PDF-1", "BM<html", "PK\x03\x04", "II*\x00", "RIFF0000WAVE", "a" * 257 + "ustar" + "a" * 9, "<a>MANIFEST-</a>", "<html></html>", "é" + "a" * 17, "é" + "a" * 18]


@pytest.mark.parametrize("name", ["f22_html_first", "f24_assigned_names"])
def test_odd_texts_equal_sql(spark, tmp_path, monkeypatch, name):
    monkeypatch.setitem(globals(), "TEXTS", ODD)
    agrees(spark, tmp_path, name)


def test_loose_json(spark):
    texts = [*TEXTS, *ODD, '["' + "\\n" * 300000 + '",]', "[" + "1," * 300000 + "]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = dict(rows.select("t", content.is_loose_json(F.col("t"))).collect())
    assert got == dict(duckdb.connect().execute("SELECT t, json_valid(t) FROM (SELECT unnest(?) AS t)", [texts]).fetchall())
    assert not spark.range(1).select(content.is_loose_json(F.lit(None).cast("string"))).first()[0]


def test_assigned_names(spark):
    """Signatures still give extensions; no number gives no name."""
    rows = spark.createDataFrame([(7, b"BM\x00"), (1234567, b"\x89PNG\r\n\x1a\n"), (None, b"{}")], "n long, data binary").withColumn("c", content.classify(F.col("data")))
    assert [r[0] for r in rows.select(content.assigned_name(F.col("n"), F.col("c.kind"), F.col("c.confidence"))).collect()] == ["file_000007.bmp", "file_1234567.png", None]
