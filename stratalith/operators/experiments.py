"""Comparisons of many layout variants over one set of scenarios, scenario generators and fixtures of the lab."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The dimensions of the survivability scenarios, in order.
REGIMES = [("metadata_intact", "none"), ("metadata_destroyed", "delete"), ("metadata_partial", "truncate"), ("metadata_conflicting", "overwrite")]
METADATA_TARGETS = ["index", "manifest", "path_checkpoint", "tail_metadata", "multiple_metadata_layers", "index_manifest"]
PAYLOAD_DAMAGES = ["none", "single_block_delete", "sparse_delete", "cluster_delete", "block_reorder", "duplicate_block_insert"]
FIRST_SEED, DATASETS = 900, ["smallfiles", "mixed", "largefiles"]
# The step of golden-ratio spreads.
GOLDEN = 0.6180339887498949


def compare(rows: DataFrame, fields: dict[str, Column], baseline: str, measures: dict[str, Column]) -> DataFrame:
    """field, key, variant, the measures and their differences to the baseline variant of the same key.

    One aggregation for all fields: every row is counted once for each.
    """
    told = rows.withColumn("_f", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.cast("string").alias("key")) for n, c in fields.items()))))
    grouped = told.groupBy(F.col("_f.field").alias("field"), F.col("_f.key").alias("key"), "variant").agg(*(m.alias(n) for n, m in measures.items()))
    base = grouped.where(F.col("variant") == baseline).select(F.col("field").alias("_bf"), F.col("key").alias("_bk"), *(F.col(n).alias(f"_b_{n}") for n in measures))
    joined = grouped.join(base, (F.col("field") == F.col("_bf")) & F.col("key").eqNullSafe(F.col("_bk")), "left")
    return joined.select("field", "key", "variant", *measures, *((F.col(n) - F.coalesce(f"_b_{n}", F.lit(0))).alias(f"delta_{n}") for n in measures))


def survivability_scenarios(spark: SparkSession) -> DataFrame:
    """The 24 scenarios: payload damages by metadata regimes; target and dataset follow from the order."""
    out = spark.range(1, numPartitions=1).select(F.posexplode(F.array(*map(F.lit, PAYLOAD_DAMAGES))).alias("i", "payload_damage"))
    out = out.select("*", F.posexplode(F.array(*(F.struct(F.lit(r).alias("regime"), F.lit(o).alias("operation")) for r, o in REGIMES))).alias("j", "r"))
    seed = F.lit(FIRST_SEED) + F.col("i") * len(REGIMES) + F.col("j")
    at = lambda values, k: F.array(*map(F.lit, values))[(k % len(values)).cast("int")]
    target = at(METADATA_TARGETS, F.col("i"))
    name = F.concat_ws("_", F.col("r.regime"), target, F.col("payload_damage"), seed.cast("string"))
    return out.select(name.alias("scenario_id"), at(DATASETS, F.col("i") + seed % 3).alias("dataset"), F.col("r.regime").alias("regime"), target.alias("target"), F.col("r.operation").alias("operation"), "payload_damage", seed.cast("long").alias("seed"))


def spread_ordinals(groups: DataFrame, key: str, size: str, fraction: Column, times: int = 3) -> DataFrame:
    """key, ordinal: up to ``times`` distinct ordinals below ``size``, a golden step apart from a fraction on; a taken one gives way to the next free.

    ``fraction`` (0 to 1) is drawn from a digest of the key; with at most three ordinals, what is taken is a short array.
    """
    wanted = F.sequence(F.lit(0), F.least(F.lit(times), F.col(size)).cast("int") - 1)
    n = F.col(size)

    def add(taken: Column, i: Column) -> Column:
        value = fraction + i * F.lit(GOLDEN)
        first = F.least(F.floor((value - F.floor(value)) * n), n - 1).cast("long")
        free = F.filter(F.sequence(F.lit(0), F.lit(times)), lambda s: ~F.array_contains(taken, (first + s) % n))
        return F.concat(taken, F.array((first + free[0]) % n))

    found = groups.where(n > 0).select(key, F.aggregate(wanted, F.array().cast("array<bigint>"), add).alias("o"))
    return found.select(key, F.explode("o").alias("ordinal"))


def small_files(spark: SparkSession) -> DataFrame:
    """path, body of the smallfiles fixture: 24 text files in six folders; file i has i + 3 lines."""
    folders = F.array(*map(F.lit, ["docs", "src", "logs", "cfg", "tmp", "notes"]))
    i = F.col("id")
    line = lambda n: F.concat(F.lit("smallfiles deterministic payload file="), i.cast("string"), F.lit(" line="), n.cast("string"), F.lit(" seed=phase2\n"))
    return spark.range(24).select(F.concat(folders[(i % 6).cast("int")], F.format_string("/file_%02d.txt", i)).alias("path"), F.array_join(F.transform(F.sequence(F.lit(0), i + 2), line), "").alias("body"))


def tree_digest(files: DataFrame, by: str, path: str, body: Column) -> DataFrame:
    """by, digest: over the ordered lines of path, zero byte stand-in and content digest; a fixture's tree is one row."""
    lines = F.sort_array(F.collect_list(F.struct(F.col(path).alias("p"), F.sha2(body.cast("binary"), 256).alias("h"))))
    return files.groupBy(by).agg(lines.alias("x")).select(by, F.sha2(F.array_join(F.transform("x", lambda e: F.concat(e["p"], F.lit(":"), e["h"], F.lit("\n"))), "").cast("binary"), 256).alias("digest"))


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """line, text of a Markdown table of a report, whose rows are few: heading, rule, then rows in order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    numbered = rows.select(F.row_number().over(Window.orderBy(*columns)).cast("long").alias("line"), cells.alias("text"))
    head = rows.sparkSession.createDataFrame([(-1, "| " + " | ".join(columns) + " |"), (0, "|" + "---|" * len(columns))], "line long, text string")
    return reduce(DataFrame.unionByName, [head, numbered])


def route(trust: Column, failed: Column) -> Column:
    """The directory that a recovered file goes to: a canonical one whose metadata could not be restored is degraded."""
    return F.when((trust == "canonical") & (F.size(failed) > 0), "metadata_degraded").otherwise(trust)
