"""Integrity, impact, refusal and propagation over files, extents and damaged blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Dependency edges every file has besides its blocks, with the reason of each.
STRUCTURES = {"structure:ftr4": "requires_footer", "structure:tail_frame": "requires_tail_frame", "structure:idx3": "requires_index"}
#: Sort rank of edge reasons.
REASON_RANK = {"requires_footer": 0, "requires_tail_frame": 1, "requires_index": 2, "requires_block": 3}


def corrupt_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks whose payload does not have the stored digest; blocks without one are skipped."""
    return blocks.where(F.col("stored_hash").isNotNull() & (F.sha2(F.col("payload").cast("binary"), 256) != F.col("stored_hash"))).select("block_id")


def affected_extents(extents: DataFrame, corrupt: DataFrame) -> DataFrame:
    """Extents on damaged blocks (semi join)."""
    return extents.join(corrupt, "block_id", "left_semi")


def impact(files: DataFrame, extents: DataFrame, corrupt: DataFrame) -> DataFrame:
    """Every file with its verdict and the number, bytes and list of its damaged extents, ordered by (block, offset, len)."""
    hit = affected_extents(extents, corrupt).groupBy("file_id").agg(
        F.count("*").alias("n_extents"),
        F.sum("len").alias("bytes"),
        F.sort_array(F.collect_list(F.struct("block_id", "logical_offset", "len"))).alias("extents"),
    )
    out = files.select("file_id", "path").join(hit, "file_id", "left")
    return out.select("file_id", "path", F.when(F.col("n_extents").isNull(), "unaffected").otherwise("affected").alias("verdict"), F.coalesce("n_extents", F.lit(0)).cast("long").alias("n_extents"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.array_join(F.transform("extents", lambda e: F.concat_ws(":", e["block_id"], e["logical_offset"], e["len"])), ",").alias("extents"))


def unaffected(files: DataFrame, extents: DataFrame, corrupt: DataFrame) -> DataFrame:
    """Files with no extent on a damaged block (anti join)."""
    return files.select("file_id", "path").join(affected_extents(extents, corrupt), "file_id", "left_anti")


def required_blocks(extents: DataFrame) -> DataFrame:
    """The distinct blocks of each file, in order."""
    return extents.groupBy("file_id").agg(F.sort_array(F.collect_set("block_id")).alias("blocks"))


def refusals(files: DataFrame, extents: DataFrame, corrupt: DataFrame) -> DataFrame:
    """safe or refused: a file is refused if any block it needs is damaged; one without extents is safe."""
    flagged = extents.join(corrupt.withColumn("bad", F.lit(True)), "block_id", "left").groupBy("file_id").agg(F.bool_or(F.coalesce("bad", F.lit(False))).alias("refused"))
    return files.select("file_id", "path").join(flagged, "file_id", "left").select("file_id", "path", F.when(F.col("refused"), "refused").otherwise("safe").alias("verdict"))


def extraction_report(verdicts: DataFrame) -> DataFrame:
    """Totals over refusals and the status of the extraction."""
    refused = F.count_if(F.col("verdict") == "refused")
    return verdicts.agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("verdict") == "safe").alias("safe"),
        refused.alias("refused"),
        F.when(refused == 0, "success").when(refused == F.count("*"), "full_refusal").otherwise("partial_refusal").alias("status"),
    )


def verification_model(verdicts: DataFrame, corrupt: DataFrame) -> DataFrame:
    """One row per refused file or damaged block of the failure domains, and per safe file."""
    files = verdicts.select(F.when(F.col("verdict") == "safe", "safe_file").otherwise("refused_file").alias("domain"), F.col("path").alias("name"))
    blocks = corrupt.select(F.lit("damaged_block").alias("domain"), F.concat(F.lit("block:"), F.col("block_id").cast("string")).alias("name"))
    return files.unionByName(blocks)


def file_node(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def block_node(block: Column) -> Column:
    return F.concat(F.lit("block:"), block.cast("string"))


def nodes(files: DataFrame, extents: DataFrame) -> DataFrame:
    """The nodes of the dependency graph: structures, needed blocks and files."""
    spark = files.sparkSession
    fixed = spark.createDataFrame([(s, "structure") for s in STRUCTURES], "id string, kind string")
    blocks = extents.select(block_node(F.col("block_id")).alias("id")).distinct().withColumn("kind", F.lit("block"))
    return fixed.unionByName(blocks).unionByName(files.select(file_node(F.col("path")).alias("id"), F.lit("file").alias("kind")))


def edges(files: DataFrame, extents: DataFrame) -> DataFrame:
    """from, to, reason and its rank: every file on every structure and on each of its blocks."""
    structure = files.select(F.explode(F.array(*(F.struct(F.lit(s).alias("from"), F.lit(r).alias("reason")) for s, r in STRUCTURES.items()))).alias("e"), file_node(F.col("path")).alias("to")).select("e.from", "to", "e.reason")
    block = extents.select("file_id", "block_id").distinct().join(files.select("file_id", "path"), "file_id").select(block_node(F.col("block_id")).alias("from"), file_node(F.col("path")).alias("to"), F.lit("requires_block").alias("reason"))
    rank = F.create_map(*(x for k, v in REASON_RANK.items() for x in (F.lit(k), F.lit(v))))
    return structure.unionByName(block).withColumn("reason_rank", rank[F.col("reason")])


def propagation(graph: DataFrame, damaged: DataFrame) -> DataFrame:
    """Impacts on files of damaged nodes (id), two hops at most: node, file, reason, and how far the impact is actual.

    Every edge is a hypothetical impact of its source; those of damaged sources are actual.
    """
    return graph.join(damaged.select(F.col("id").alias("from"), F.lit("actual").alias("impact")), "from", "left").select(F.col("from").alias("cause"), F.col("to").alias("file"), "reason", F.coalesce("impact", F.lit("hypothetical")).alias("impact"))
