"""Integrity queries over the bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..bindings import duck, frame
from ..operators import integrity as op, ranges
from .registry import query


def _three(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return frame(spark, d, "files"), frame(spark, d, "extents"), frame(spark, d, "corrupt_blocks")


_VERDICT = "SELECT f.file_id, f.path, CASE WHEN EXISTS (SELECT 1 FROM extents e JOIN corrupt_blocks c ON e.block_id = c.block_id WHERE e.file_id = f.file_id) THEN 'refused' ELSE 'safe' END AS verdict FROM files f"


@query("v1_corrupt_blocks", duck("SELECT block_id FROM blocks WHERE block_id % 13 <> 0 AND sha256(payload) <> CASE WHEN corrupt THEN sha256('!' || payload) ELSE sha256(payload) END"))
def v1(spark, d):
    """Deep verification: recompute digests and compare; every 13th block stores none."""
    stored = F.when(F.col("block_id") % 13 != 0, F.sha2(F.when(F.col("corrupt"), F.concat(F.lit("!"), "payload")).otherwise(F.col("payload")).cast("binary"), 256))
    return op.corrupt_blocks(frame(spark, d, "blocks").withColumn("stored_hash", stored))


@query("j1_affected_extents", duck("SELECT e.file_id, e.block_id, e.ordinal, e.len FROM extents e WHERE e.block_id IN (SELECT block_id FROM corrupt_blocks)"))
def j1(spark, d):
    _, e, c = _three(spark, d)
    return op.affected_extents(e, c).select("file_id", "block_id", F.col("ordinal").cast("long").alias("ordinal"), "len")


@query("j1_unaffected_files", duck("SELECT f.file_id, f.path FROM files f WHERE NOT EXISTS (SELECT 1 FROM extents e JOIN corrupt_blocks c ON e.block_id = c.block_id WHERE e.file_id = f.file_id)"))
def j1_anti(spark, d):
    return op.unaffected(*_three(spark, d))


@query(
    "v2_impact_report",
    duck("""SELECT f.file_id, f.path, CASE WHEN h.n IS NULL THEN 'unaffected' ELSE 'affected' END AS verdict, COALESCE(h.n, 0) AS n_extents, CAST(COALESCE(h.b, 0) AS BIGINT) AS bytes, h.x AS extents
        FROM files f LEFT JOIN (SELECT e.file_id, COUNT(*) n, SUM(e.len) b, string_agg(e.block_id || ':' || CAST(e.logical_offset AS BIGINT) || ':' || e.len, ',' ORDER BY e.block_id, e.logical_offset, e.len) x
        FROM extents e JOIN corrupt_blocks c ON e.block_id = c.block_id GROUP BY e.file_id) h ON f.file_id = h.file_id"""),
)
def v2(spark, d):
    return op.impact(*_three(spark, d))


@query("j2_refusals", duck(_VERDICT))
def j2(spark, d):
    return op.refusals(*_three(spark, d))


@query("a11_required_blocks", duck("SELECT file_id, string_agg(CAST(block_id AS STRING), ',' ORDER BY block_id) AS blocks FROM (SELECT DISTINCT file_id, block_id FROM extents) GROUP BY file_id"))
def a11(spark, d):
    return op.required_blocks(frame(spark, d, "extents")).select("file_id", F.array_join(F.transform("blocks", lambda b: b.cast("string")), ",").alias("blocks"))


@query("a27_extraction_report", duck(f"SELECT COUNT(*) AS candidates, COUNT(*) FILTER (verdict = 'safe') AS safe, COUNT(*) FILTER (verdict = 'refused') AS refused, CASE WHEN COUNT(*) FILTER (verdict = 'refused') = 0 THEN 'success' WHEN COUNT(*) FILTER (verdict = 'safe') = 0 THEN 'full_refusal' ELSE 'partial_refusal' END AS status FROM ({_VERDICT})"))
def a27(spark, d):
    return op.extraction_report(op.refusals(*_three(spark, d)))


@query("a28_verification_model", duck(f"SELECT CASE verdict WHEN 'safe' THEN 'safe_file' ELSE 'refused_file' END AS domain, path AS name FROM ({_VERDICT}) UNION ALL SELECT 'damaged_block', 'block:' || block_id FROM corrupt_blocks"))
def a28(spark, d):
    return op.verification_model(j2(spark, d), frame(spark, d, "corrupt_blocks"))


@query("u1_verdict_union", duck("SELECT path, 'refused' AS verdict FROM files WHERE file_id IN (SELECT file_id FROM extents e JOIN corrupt_blocks c ON e.block_id = c.block_id) UNION ALL SELECT path, 'safe' FROM files WHERE file_id NOT IN (SELECT file_id FROM extents e JOIN corrupt_blocks c ON e.block_id = c.block_id)"))
def u1(spark, d):
    f, e, c = _three(spark, d)
    bad = f.join(op.affected_extents(e, c), "file_id", "left_semi").select("path", F.lit("refused").alias("verdict"))
    return bad.unionByName(op.unaffected(f, e, c).select("path", F.lit("safe").alias("verdict"))).orderBy("path")


@query("j3_block_edges", duck("SELECT DISTINCT 'block:' || e.block_id AS source, 'file:' || f.path AS target FROM extents e JOIN files f ON e.file_id = f.file_id"))
def j3(spark, d):
    f, e, _ = _three(spark, d)
    return op.edges(f, e).where("reason = 'requires_block'").select(F.col("from").alias("source"), F.col("to").alias("target"))


_EDGES = """SELECT s.n AS source, 'file:' || f.path AS target, s.r AS reason, s.k AS reason_rank FROM files f, (VALUES ('structure:ftr4', 'requires_footer', 0), ('structure:tail_frame', 'requires_tail_frame', 1), ('structure:idx3', 'requires_index', 2)) s(n, r, k)
    UNION ALL SELECT DISTINCT 'block:' || e.block_id, 'file:' || f.path, 'requires_block', 3 FROM extents e JOIN files f ON e.file_id = f.file_id"""


@query("u2_graph_nodes", duck("SELECT 'structure:' || s AS id, 'structure' AS kind FROM (VALUES ('ftr4'), ('tail_frame'), ('idx3')) v(s) UNION ALL SELECT DISTINCT 'block:' || block_id, 'block' FROM extents UNION ALL SELECT 'file:' || path, 'file' FROM files"))
def u2(spark, d):
    f, e, _ = _three(spark, d)
    return op.nodes(f, e)


@query("o3_sorted_edges", duck(_EDGES))
def o3(spark, d):
    f, e, _ = _three(spark, d)
    return op.edges(f, e).select(F.col("from").alias("source"), F.col("to").alias("target"), "reason", "reason_rank").orderBy("source", "target", "reason_rank")


@query("v3_propagation", duck(f"SELECT source AS cause, target AS file, reason, CASE WHEN source = 'structure:idx3' OR source IN (SELECT 'block:' || block_id FROM corrupt_blocks) THEN 'actual' ELSE 'hypothetical' END AS impact FROM ({_EDGES})"))
def v3(spark, d):
    """With the index and every eleventh block damaged."""
    f, e, c = _three(spark, d)
    bad = c.select(op.block_node(F.col("block_id")).alias("id")).union(spark.createDataFrame([("structure:idx3",)], "id string"))
    return op.propagation(op.edges(f, e), bad)


@query("h14_structural_report", "SELECT 'structure:idx3' AS cause, CAST(0 AS BIGINT) AS files")
def h14(spark, d):
    """Without files only the damaged structure is left to report."""
    f = frame(spark, d, "files").limit(0)
    hit = op.propagation(op.edges(f, frame(spark, d, "extents").limit(0)), spark.createDataFrame([("structure:idx3",)], "id string"))
    return spark.createDataFrame([("structure:idx3",)], "cause string").join(hit, "cause", "left").groupBy("cause").agg(F.count("file").alias("files"))


@query("h15_node_ids", duck("SELECT 'file:' || path AS file_node, 'block:' || file_id AS block_node FROM files"))
def h15(spark, d):
    return frame(spark, d, "files").select(op.file_node(F.col("path")).alias("file_node"), op.block_node(F.col("file_id")).alias("block_node"))


@query("o1_paths_in_order", duck("SELECT path, file_id, ROW_NUMBER() OVER (ORDER BY path, file_id) AS place FROM files"))
def o1(spark, d):
    """All paths in byte order with their places."""
    rows = frame(spark, d, "files").select("path", "file_id")
    return ranges.place(rows, [], [F.col("path"), F.col("file_id")], "place").orderBy("path", "file_id")


@query("o2_extent_order", duck("SELECT file_id, string_agg(block_id || ':' || CAST(logical_offset AS BIGINT) || ':' || len, ',' ORDER BY block_id, logical_offset, len) AS extents FROM extents GROUP BY file_id"))
def o2(spark, d):
    e = frame(spark, d, "extents").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("block_id", "logical_offset", "len"))).alias("x"))
    return e.select("file_id", F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["block_id"], x["logical_offset"], x["len"])), ",").alias("extents"))


@query("h10_snapshot", duck("SELECT COUNT(*) AS files, CAST(SUM(size) AS BIGINT) AS bytes, (SELECT COUNT(*) FROM blocks) AS blocks, (SELECT COUNT(*) FROM corrupt_blocks) AS corrupt, (SELECT COUNT(DISTINCT e.file_id) FROM extents e JOIN corrupt_blocks c ON e.block_id = c.block_id) AS affected FROM files"))
def h10(spark, d):
    """Info and check snapshots in one row; the affected files come from real extents."""
    f, e, c = _three(spark, d)
    return f.agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).crossJoin(frame(spark, d, "blocks").agg(F.count("*").alias("blocks"))).crossJoin(c.agg(F.count("*").alias("corrupt"))).crossJoin(op.affected_extents(e, c).agg(F.countDistinct("file_id").alias("affected")))


@query("k9_snapshot_fingerprint", duck("SELECT block_id, sha256(sha256(payload) || sha256(codec)) AS fingerprint FROM blocks"))
def k9(spark, d):
    """Fingerprint of two digests, here of payload and codec."""
    h = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return frame(spark, d, "blocks").select("block_id", F.sha2(F.concat(h("payload"), h("codec")).cast("binary"), 256).alias("fingerprint"))
