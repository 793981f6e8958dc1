"""File trees, JSON records and report files of the lab."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def tree(spark: SparkSession, path: str) -> DataFrame:
    """relative_path, size, modified of all files under a folder, in path order; contents are not read.

    The reader passes over empty files, so these come from its file index, without a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/").removeprefix("file://").removeprefix("file:")
    relative = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), f"^{base}/", "")
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "listed string").select(relative("listed").alias("relative_path"))
    found = files.select(relative("path").alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return listed.join(found, "relative_path", "left").select("relative_path", F.coalesce("size", F.lit(0)).alias("size"), "modified").orderBy("relative_path")


def size_map(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes of an extracted tree."""
    return tree(spark, path).select(F.col("relative_path").alias("path"), F.col("size").alias("bytes"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files that hold an array or an object each, by one schema; a file that does not parse fails the read."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)


def json_array(column: Column, schema: str) -> Column:
    """The records of a JSON array in a column; null where it does not parse."""
    return F.from_json(column, f"array<struct<{schema}>>")


def raw_field(record: Column, name: str) -> Column:
    """The source text of a top-level object or array of a JSON record, bytes as they stand; null if it is not there.

    Values are skipped one by one with a decoder that tells where each ends, so nested fields of
    the same name do not count.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cut(texts):
        import json

        decoder = json.JSONDecoder()

        def one(text):
            if text is None:
                return None
            at = text.find("{") + 1
            while 0 < at < len(text):
                at += len(text[at:]) - len(text[at:].lstrip(" \t\r\n,"))
                if at >= len(text) or text[at] == "}":
                    return None
                try:
                    key, at = decoder.raw_decode(text, at)
                    at = text.index(":", at) + 1
                    at += len(text[at:]) - len(text[at:].lstrip())
                    _, end = decoder.raw_decode(text, at)
                except ValueError:
                    return None
                if key == name:
                    return text[at:end]
                at = end
            return None

        return texts.map(one)

    return cut(record)


def latest_runs(runs: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of every run, for runs that were written again."""
    others = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines; reports are few rows, in one file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_list(files: DataFrame, path: str, *order: str) -> None:
    """An ordered list of paths, one a line, split by ranges of the order."""
    files.orderBy(*order).select(F.col("path").alias("value")).write.mode("overwrite").text(path)


def write_recovered(files: DataFrame, path: str) -> None:
    """Recovered files (trust_class, name, data) by trust class, with a manifest of all."""
    files.select("trust_class", "name", "data").write.mode("overwrite").partitionBy("trust_class").parquet(f"{path}/files")
    files.select("trust_class", "name", F.octet_length("data").alias("size"), F.sha2("data", 256).alias("sha256")).write.mode("overwrite").json(f"{path}/manifest")
