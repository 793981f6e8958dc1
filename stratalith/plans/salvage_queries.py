"""Salvage queries over the bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import duck, frame
from ..operators import ranges, salvage as op
from .registry import query

_CAND = "SELECT block_id * 4096 + CASE WHEN block_id % 5 = 0 THEN 7 ELSE 0 END AS scan_offset, NOT corrupt AS usable FROM blocks"


def _candidates(spark, d):
    """What a scan finds: every fifth candidate is off the index."""
    return frame(spark, d, "blocks").select((F.col("block_id") * 4096 + F.when(F.col("block_id") % 5 == 0, 7).otherwise(0)).alias("scan_offset"), (~F.col("corrupt")).alias("usable"))


def _mapped(spark, d):
    return op.map_candidates(frame(spark, d, "blocks"), _candidates(spark, d))


@query("j9_map_candidates", duck(f"SELECT c.scan_offset, c.usable, b.block_id AS mapped_block_id, CASE WHEN b.block_id IS NULL THEN 'orphan' ELSE 'mapped' END AS state FROM ({_CAND}) c LEFT JOIN blocks b ON c.scan_offset = b.scan_offset"))
def j9(spark, d):
    return _mapped(spark, d)


@query("a10_plan_totals", duck(f"SELECT COUNT(*) AS total, COUNT(*) FILTER (c.usable) AS usable, COUNT(b.block_id) AS mapped, COUNT(*) - COUNT(b.block_id) AS orphan FROM ({_CAND}) c LEFT JOIN blocks b ON c.scan_offset = b.scan_offset"))
def a10(spark, d):
    return op.plan_totals(_mapped(spark, d))


_NAMED = "SELECT i.file_id, i.block_id, i.block_index, i.total_blocks, i.path_id, COALESCE(CASE WHEN p.digest_ok THEN p.path END, 'anonymous/' || i.file_id) AS name FROM identity i LEFT JOIN paths p ON i.path_id = p.path_id"


@query("j10_resolved_paths", duck(f"SELECT name, COUNT(*) AS n, COUNT(DISTINCT file_id) AS files FROM ({_NAMED}) GROUP BY name"))
def j10(spark, d):
    return op.resolve_paths(frame(spark, d, "identity"), frame(spark, d, "paths")).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


@query("j11_factored_paths", duck("SELECT path_id, root_name || '/' || dir_name || '/' || path AS full_path FROM paths JOIN directories ON paths.dir_id = directories.dir_id JOIN roots ON directories.root_id = roots.root_id"))
def j11(spark, d):
    return op.factored_paths(frame(spark, d, "paths"), frame(spark, d, "directories"), frame(spark, d, "roots"))


@query("j12_lookup_with_fallback", duck("SELECT f.file_id, COALESCE(a.path_id, b.path_id) AS path_id FROM files f LEFT JOIN paths a ON f.path = a.path LEFT JOIN paths b ON TRY_CAST(regexp_extract(f.path, '([0-9]+)$', 1) AS BIGINT) = b.path_id"))
def j12(spark, d):
    """By path, else by the id parsed from the name."""
    p = frame(spark, d, "paths")
    f = frame(spark, d, "files").withColumn("parsed", F.regexp_extract("path", "([0-9]+)$", 1).try_cast("long"))
    a = p.select("path", F.col("path_id").alias("by_path"))
    b = p.select(F.col("path_id").alias("parsed"), F.col("path_id").alias("by_id"))
    return f.join(a, "path", "left").join(b, "parsed", "left").select("file_id", F.coalesce("by_path", "by_id").alias("path_id"))


_STATUS = "SELECT e.file_id, COUNT(*) FILTER (b.block_id IS NULL) AS missing, COUNT(*) FILTER (b.corrupt) AS damaged, COUNT(*) AS n FROM extents e LEFT JOIN blocks b ON e.block_id = b.block_id GROUP BY e.file_id"


@query("j13_classified_files", duck(f"SELECT file_id, missing, damaged, CASE WHEN missing > 0 THEN 'block_missing' WHEN damaged > 0 THEN 'block_damaged' END AS primary_reason, CASE WHEN missing + damaged = 0 THEN 'salvageable' WHEN missing + damaged < n THEN 'partial' ELSE 'unsalvageable' END AS status FROM ({_STATUS})"))
def j13(spark, d):
    return op.classify_extents(frame(spark, d, "extents"), frame(spark, d, "blocks"))


@query("u5_reason_sets", duck(f"SELECT file_id, CASE WHEN missing > 0 AND damaged > 0 THEN 'block_missing,block_damaged' WHEN missing > 0 THEN 'block_missing' WHEN damaged > 0 THEN 'block_damaged' ELSE '' END AS reasons FROM ({_STATUS})"))
def u5(spark, d):
    return j13(spark, d).select("file_id", F.array_join(op.reasons({"block_missing": F.col("missing") > 0, "block_damaged": F.col("damaged") > 0}), ",").alias("reasons"))


@query("o10_primary_reasons", duck(f"SELECT primary_reason, COUNT(*) AS n FROM (SELECT CASE WHEN missing > 0 THEN 'block_missing' WHEN damaged > 0 THEN 'block_damaged' END AS primary_reason FROM ({_STATUS})) GROUP BY primary_reason"))
def o10(spark, d):
    return j13(spark, d).groupBy("primary_reason").agg(F.count("*").alias("n"))


_ORD = "SELECT file_id, bool_or(rn <> block_index) AS has_gap, bool_or(same > 1) AS has_duplicate, COUNT(*) AS n FROM (SELECT file_id, block_index, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY block_index, block_id, path_id) - 1 AS rn, COUNT(*) OVER (PARTITION BY file_id, block_index) AS same FROM identity) GROUP BY file_id"


@query("w2_ordinal_gaps", duck(f"SELECT file_id, has_gap FROM ({_ORD})"))
def w2(spark, d):
    return op.ordinal_check(frame(spark, d, "identity"), "file_id", "block_index", ["block_id", "path_id"]).select("file_id", "has_gap")


@query("w3_duplicate_ordinals", duck(f"SELECT file_id, has_duplicate FROM ({_ORD})"))
def w3(spark, d):
    return op.ordinal_check(frame(spark, d, "identity"), "file_id", "block_index", ["block_id", "path_id"]).select("file_id", "has_duplicate")


_CONT = "SELECT file_id, bool_and(logical_offset = pe) AS contiguous, CAST(SUM(len) AS BIGINT) AS covered FROM (SELECT file_id, logical_offset, len, LAG(logical_offset + len, 1, 0) OVER (PARTITION BY file_id ORDER BY ordinal) AS pe FROM extents) GROUP BY file_id"


@query("w4_contiguity", duck(_CONT))
def w4(spark, d):
    return op.contiguity(frame(spark, d, "extents"), "file_id", ["ordinal"])


@query("w5_order_check", duck("SELECT file_id, bool_and(pb IS NULL OR pb <= logical_offset) AS ordered FROM (SELECT file_id, logical_offset, LAG(logical_offset) OVER (PARTITION BY file_id ORDER BY block_id, ordinal) AS pb FROM extents) GROUP BY file_id"))
def w5(spark, d):
    return op.in_order(frame(spark, d, "extents"), "file_id", ["block_id", "ordinal"])


@query("w8_write_cursor", duck("SELECT file_id, ordinal, CAST(COALESCE(SUM(len) OVER (PARTITION BY file_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS write_at FROM extents"))
def w8(spark, d):
    return op.write_cursor(frame(spark, d, "extents"), "file_id", ["ordinal"]).select("file_id", "ordinal", "write_at")


@query("w9_checkpoints", duck("SELECT file_id, ordinal, anchor FROM (SELECT file_id, ordinal, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY ordinal) AS rn, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY ordinal) IN (1, COUNT(*) OVER (PARTITION BY file_id)) AS anchor FROM extents) WHERE rn % 2 = 0 OR anchor"))
def w9(spark, d):
    return op.checkpoints(frame(spark, d, "extents"), "file_id", "ordinal").select("file_id", "ordinal", "anchor")


@query("w11_first_wins", duck("SELECT path_id, arg_min(file_id, block_id * 1000000 + file_id) AS first_file FROM identity GROUP BY path_id"))
def w11(spark, d):
    return frame(spark, d, "identity").groupBy("path_id").agg(F.min_by("file_id", F.col("block_id") * 1000000 + F.col("file_id")).alias("first_file"))


_CLASSES = f"SELECT i.file_id, COUNT(DISTINCT i.block_id) FILTER (NOT b.corrupt) AS found, MAX(i.total_blocks) AS expected, bool_or(p.digest_ok) AS named, NOT bool_or(o.has_gap) AS ordered FROM identity i LEFT JOIN paths p ON i.path_id = p.path_id LEFT JOIN blocks b ON i.block_id = b.block_id LEFT JOIN ({_ORD}) o ON i.file_id = o.file_id GROUP BY i.file_id"


@query("f20_recovery_classes", duck(f"SELECT file_id, found, CASE WHEN found = expected AND found > 0 AND named THEN 'FULL_VERIFIED' WHEN found = expected AND found > 0 THEN 'FULL_ANONYMOUS' WHEN found > 0 AND ordered THEN 'PARTIAL_ORDERED' WHEN found > 0 THEN 'PARTIAL_UNORDERED' ELSE 'ORPHAN_BLOCKS' END AS class FROM ({_CLASSES})"))
def f20(spark, d):
    """Verified blocks of each file against the expected count, its name and its order."""
    i = frame(spark, d, "identity")
    good = i.join(frame(spark, d, "blocks").select("block_id", "corrupt"), "block_id", "left").join(frame(spark, d, "paths").select("path_id", "digest_ok"), "path_id", "left")
    seen = good.groupBy("file_id").agg(F.countDistinct(F.when(~F.col("corrupt"), F.col("block_id"))).alias("found"), F.max("total_blocks").alias("expected"), F.coalesce(F.bool_or("digest_ok"), F.lit(False)).alias("named"))
    order = op.ordinal_check(i, "file_id", "block_index", ["block_id", "path_id"]).select("file_id", (~F.col("has_gap")).alias("ordered"))
    return seen.join(order, "file_id").select("file_id", "found", op.recovery_class(F.col("found"), F.col("expected"), F.col("named"), F.col("ordered")).alias("class"))


@query("v11_unshared_claims", duck("SELECT file_id, block_id FROM identity WHERE block_id NOT IN (SELECT block_id FROM identity GROUP BY block_id HAVING COUNT(DISTINCT file_id) > 1)"))
def v11(spark, d):
    """Claims of all files on blocks that no other file claims; in these tables most blocks are shared."""
    return op.reject_shared_blocks(frame(spark, d, "identity").select("file_id", "block_id"))


_SRC = "SELECT file_id % 97 AS archive, file_id, 0 AS priority FROM extents WHERE file_id % 97 < 30 UNION ALL SELECT file_id % 97, file_id, 1 FROM identity WHERE file_id % 97 < 60 UNION ALL SELECT file_id % 97, file_id, 2 FROM files"


@query("u6_fallback_chain", duck(f"WITH s AS ({_SRC}) SELECT archive, priority, COUNT(*) AS n FROM s WHERE priority = (SELECT MIN(t.priority) FROM s t WHERE t.archive = s.archive) GROUP BY archive, priority"))
def u6(spark, d):
    src = lambda v: frame(spark, d, v).select((F.col("file_id") % 97).alias("archive"), "file_id")
    rows = op.first_source([src("extents").where("archive < 30"), src("identity").where("archive < 60"), src("files")], "archive")
    return rows.groupBy("archive", F.col("priority").cast("int").alias("priority")).agg(F.count("*").alias("n"))


_TRUST = "SELECT f.file_id, CASE WHEN COALESCE(x.damaged, 0) = 0 THEN 'canonical' WHEN COALESCE(x.good, 0) = 0 THEN 'unrecoverable' WHEN x.good = x.total THEN 'recovered_named' ELSE 'recovered_anonymous' END AS trust FROM files f LEFT JOIN (SELECT e.file_id, COUNT(*) FILTER (b.corrupt) AS damaged, SUM(CASE WHEN b.corrupt THEN 0 ELSE e.len END) AS good, SUM(e.len) AS total FROM extents e JOIN blocks b ON e.block_id = b.block_id GROUP BY e.file_id) x ON f.file_id = x.file_id"


@query("f21_trust_classes", duck(_TRUST))
def f21(spark, d):
    e = frame(spark, d, "extents").join(frame(spark, d, "blocks").select("block_id", "corrupt"), "block_id")
    x = e.groupBy("file_id").agg(F.count_if("corrupt").alias("damaged"), F.sum(F.when(F.col("corrupt"), 0).otherwise(F.col("len"))).alias("good"), F.sum("len").alias("total"))
    f = frame(spark, d, "files").select("file_id").join(x, "file_id", "left").na.fill(0, ["damaged", "good", "total"])
    return f.select("file_id", op.trust_class(F.col("good"), F.col("total"), F.col("damaged") > 0).alias("trust"))


@query("v5_recovery_summary", duck(f"SELECT trust, COUNT(*) AS n FROM ({_TRUST}) GROUP BY trust"))
def v5(spark, d):
    return f21(spark, d).groupBy("trust").agg(F.count("*").alias("n"))


@query("a26_recovery_verdict", duck(f"SELECT COUNT(*) FILTER (trust = 'canonical') AS canonical, COUNT(*) FILTER (trust = 'unrecoverable') AS lost, CASE WHEN COUNT(*) FILTER (trust <> 'canonical') = 0 THEN 'COMPLETE' WHEN COUNT(*) FILTER (trust <> 'unrecoverable') = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS verdict FROM ({_TRUST})"))
def a26(spark, d):
    t = F.col("trust")
    return f21(spark, d).agg(F.count_if(t == "canonical").alias("canonical"), F.count_if(t == "unrecoverable").alias("lost"), F.when(F.count_if(t != "canonical") == 0, "COMPLETE").when(F.count_if(t != "unrecoverable") == 0, "FAILED").otherwise("PARTIAL").alias("verdict"))


@query("h3_last_path_wins", duck("SELECT dir_id, arg_max(path, path_id) AS path FROM paths WHERE digest_ok GROUP BY dir_id"))
def h3(spark, d):
    return frame(spark, d, "paths").where("digest_ok").groupBy("dir_id").agg(F.max_by("path", "path_id").alias("path"))


@query("h4_required_fields", duck("SELECT scenario_id, tool_version FROM raw_runs WHERE tool_version IS NOT NULL AND scenario_id IS NOT NULL"))
def h4(spark, d):
    return frame(spark, d, "raw_runs").dropna(subset=["scenario_id", "tool_version"]).select("scenario_id", "tool_version")


@query("h5_anchor_count", duck("SELECT COUNT(*) FILTER (ordinal = 0) AS anchors FROM extents"))
def h5(spark, d):
    return frame(spark, d, "extents").agg(F.count_if(F.col("ordinal") == 0).alias("anchors"))


@query("h33_byte_totals", duck("SELECT CAST(SUM(raw_len) AS BIGINT) AS raw, CAST(SUM(comp_len) AS BIGINT) AS comp, CAST(SUM(comp_len + 44) AS BIGINT) AS frames FROM blocks"))
def h33(spark, d):
    return frame(spark, d, "blocks").agg(F.sum("raw_len").alias("raw"), F.sum("comp_len").alias("comp"), F.sum(F.col("comp_len") + 44).alias("frames"))


@query("h34_packed_blocks", duck("SELECT kind, file_id, CAST(SUM(size) OVER (PARTITION BY kind ORDER BY path, file_id) // 100000 AS BIGINT) AS block FROM files"))
def h34(spark, d):
    """Files share blocks of a size: the running sum of sizes, floor-divided."""
    run = ranges.running(frame(spark, d, "files").select("kind", "file_id", "path", "size"), ["kind"], [F.col("path"), F.col("file_id")], F.col("size"), "run")
    return run.select("kind", "file_id", F.floor(F.col("run") / 100000).cast("long").alias("block"))
