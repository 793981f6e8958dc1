"""Salvage planning: verified candidates, ordinal gaps, contiguity, dictionaries, fallback and recovery classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Reasons in their order; the first that holds is the primary reason.
REASONS = ["block_missing", "block_damaged", "extent_gap", "size_mismatch"]


def map_candidates(spans: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scan candidates with the block they are at, by offset; the rest are orphans."""
    at = spans.select(F.col("scan_offset"), F.col("block_id").alias("mapped_block_id"))
    return candidates.join(at, "scan_offset", "left").withColumn("state", F.when(F.col("mapped_block_id").isNull(), "orphan").otherwise("mapped"))


def plan_totals(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count("*").alias("total"), F.count_if("usable").alias("usable"), F.count_if(F.col("state") == "mapped").alias("mapped"), F.count_if(F.col("state") == "orphan").alias("orphan"))


def resolve_paths(identity: DataFrame, paths: DataFrame) -> DataFrame:
    """Identity records with the path of their dictionary entry if its digest holds, else an anonymous name."""
    return identity.join(paths, "path_id", "left").withColumn("name", F.coalesce(F.when(F.col("digest_ok"), F.col("path")), F.concat(F.lit("anonymous/"), F.col("file_id").cast("string"))))


def factored_paths(paths: DataFrame, directories: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths from bindings, directories and roots (a star join); dictionaries are dimension tables that AQE broadcasts."""
    return paths.join(directories, "dir_id").join(roots, "root_id").select("path_id", F.concat_ws("/", "root_name", "dir_name", "path").alias("full_path"))


def ordinal_check(rows: DataFrame, group: str, index: str, order: list[str]) -> DataFrame:
    """Per group: whether the sorted index is 0..n-1 (else a gap), and whether one stands twice."""
    w = Window.partitionBy(group).orderBy(index, *order)
    numbered = rows.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_same", F.count("*").over(Window.partitionBy(group, index)))
    return numbered.groupBy(group).agg(F.bool_or(F.col("_rn") != F.col(index)).alias("has_gap"), F.bool_or(F.col("_same") > 1).alias("has_duplicate"), F.count("*").alias("n"))


def contiguity(extents: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Per group: whether each extent begins where the one before ends, and the bytes covered."""
    w = Window.partitionBy(group).orderBy(*order)
    end = F.lag(F.col("logical_offset") + F.col("len"), 1, 0).over(w)
    return extents.withColumn("_ok", F.col("logical_offset") == end).groupBy(group).agg(F.bool_and("_ok").alias("contiguous"), F.sum("len").alias("covered"))


def in_order(extents: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Whether offsets never fall along the given order."""
    before = F.lag("logical_offset").over(Window.partitionBy(group).orderBy(*order))
    return extents.withColumn("_ok", F.coalesce(before <= F.col("logical_offset"), F.lit(True))).groupBy(group).agg(F.bool_and("_ok").alias("ordered"))


def write_cursor(extents: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Where each extent is written: the running sum of the lengths before it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return extents.withColumn("write_at", F.coalesce(F.sum("len").over(w), F.lit(0)))


def reasons(flags: dict[str, Column]) -> Column:
    """The reasons that hold, in order."""
    return F.array_compact(F.array(*(F.when(flags[r], r) for r in REASONS if r in flags)))


def classify_extents(extents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per file: damaged and missing blocks, reasons and the primary one, and the salvage status."""
    known = blocks.select("block_id", (~F.col("corrupt")).alias("verified"))
    joined = extents.join(known, "block_id", "left")
    out = joined.groupBy("file_id").agg(F.count_if(F.col("verified").isNull()).alias("missing"), F.count_if(~F.col("verified")).alias("damaged"), F.count("*").alias("n"))
    out = out.withColumn("reasons", reasons({"block_missing": F.col("missing") > 0, "block_damaged": F.col("damaged") > 0}))
    bad = F.col("missing") + F.col("damaged")
    status = F.when(bad == 0, "salvageable").when(bad < F.col("n"), "partial").otherwise("unsalvageable")
    return out.select("file_id", "missing", "damaged", F.try_element_at("reasons", F.lit(1)).alias("primary_reason"), status.alias("status"))


def recovery_class(found: Column, expected: Column, named: Column, ordered: Column) -> Column:
    return F.when((found == expected) & (found > 0) & named, "FULL_VERIFIED").when((found == expected) & (found > 0), "FULL_ANONYMOUS").when((found > 0) & ordered, "PARTIAL_ORDERED").when(found > 0, "PARTIAL_UNORDERED").otherwise("ORPHAN_BLOCKS")


def trust_class(recovered: Column, size: Column, refused: Column) -> Column:
    return F.when(~refused, "canonical").when(recovered == 0, "unrecoverable").when(recovered == size, "recovered_named").otherwise("recovered_anonymous")


def first_source(sources: list[DataFrame], archive: str) -> DataFrame:
    """Rows of the first source, in the order given, that has any for an archive."""
    tagged = reduce(DataFrame.unionByName, (s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources)))
    best = tagged.groupBy(F.col(archive).alias("_a")).agg(F.min("priority").alias("_p"))
    return tagged.join(best, (F.col(archive) == F.col("_a")) & (F.col("priority") == F.col("_p"))).drop("_a", "_p")


def reject_shared_blocks(claims: DataFrame) -> DataFrame:
    """Claims on blocks that a single file claims."""
    shared = claims.groupBy("block_id").agg(F.countDistinct("file_id").alias("k")).where("k > 1")
    return claims.join(shared, "block_id", "left_anti")


def checkpoints(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Every second ordinal, with the first and last marked as anchors."""
    w = Window.partitionBy(group).orderBy(order)
    n = F.count("*").over(Window.partitionBy(group))
    out = rows.withColumn("rn", F.row_number().over(w)).withColumn("anchor", (F.col("rn") == 1) | (F.col("rn") == n))
    return out.where((F.col("rn") % 2 == 0) | F.col("anchor"))
