"""Run results as a stream: an extra of the engine, which batch operators share their expressions with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is explicit."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, time: str, kind: str, length: str, late: str) -> DataFrame:
    """Events and distinct-free value sums per window and kind; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), kind, "n", "value")
