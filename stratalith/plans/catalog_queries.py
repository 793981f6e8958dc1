"""Catalogue queries over the bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import duck, frame
from ..operators import catalog as op, ranges
from .registry import query


def _files(spark, d):
    return frame(spark, d, "files")


_REASON = "CASE WHEN '{p}' = 'basic' AND kind IN ('fifo', 'char_device', 'block_device') THEN 'basic_omits_special_entries' WHEN '{p}' = 'payload_only' AND kind = 'symlink' THEN 'payload_only_omits_symlinks' WHEN '{p}' = 'payload_only' AND kind IN ('fifo', 'char_device', 'block_device') THEN 'payload_only_omits_special_entries' END"

for _p in ("full", "basic", "payload_only"):

    @query(f"p3_omissions_{_p}", duck(f"SELECT file_id, kind, {_REASON.format(p=_p)} AS reason FROM files"))
    def _omit(spark, d, p=_p):
        return op.profile_plan(_files(spark, d), p).select("file_id", "kind", F.col("omission_reason").alias("reason"))


@query("v13_profile_plan", duck(f"SELECT file_id, CASE WHEN kind IN ('regular', 'directory') THEN 0 ELSE mode END AS mode, CASE WHEN kind IN ('regular', 'directory') THEN -1 ELSE mtime END AS mtime, CASE WHEN kind <> 'regular' THEN hardlink_key END AS hardlink_key, sparse AND kind <> 'regular' AS sparse, CAST(0 AS BIGINT) AS uid FROM files WHERE {_REASON.format(p='payload_only')} IS NULL"))
def v13(spark, d):
    return op.profile_plan(_files(spark, d), "payload_only").where("omission_reason IS NULL").select("file_id", "mode", "mtime", "hardlink_key", "sparse", "uid")


@query("p4_basic_blanking", duck("SELECT file_id, CAST(0 AS BIGINT) AS uid, CAST(0 AS BIGINT) AS gid, CAST(NULL AS STRING) AS uname, mode FROM files"))
def p4(spark, d):
    return op.profile_plan(_files(spark, d), "basic").select("file_id", "uid", "gid", "uname", "mode")


@query("p5_capture_requirements", "SELECT * FROM (VALUES ('full', true, true, true), ('basic', false, false, true), ('payload_only', false, false, false)) v(profile, ownership_names, xattrs, sparse_layout)")
def p5(spark, d):
    return op.capture_requirements(spark)


@query("p1_regular_files", duck("SELECT file_id, path FROM files WHERE kind = 'regular'"))
def p1(spark, d):
    return _files(spark, d).where("kind = 'regular'").select("file_id", "path")


@query("p2_path_selection", duck("SELECT f.file_id, f.path, COUNT(e.block_id) AS extents FROM files f LEFT JOIN extents e ON f.file_id = e.file_id WHERE f.path IN ('1-URGENT/5', '2-HIGH/7', '5-LOW/1') OR f.file_id < 40 GROUP BY f.file_id, f.path"))
def p2(spark, d):
    """The selection is pushed ahead of the join."""
    some = _files(spark, d).where(F.col("path").isin("1-URGENT/5", "2-HIGH/7", "5-LOW/1") | (F.col("file_id") < 40)).select("file_id", "path")
    return some.join(frame(spark, d, "extents").select("file_id", "block_id"), "file_id", "left").groupBy("file_id", "path").agg(F.count("block_id").alias("extents"))


def _like(suffixes) -> str:
    return "(" + " OR ".join(f"ends_with(lower(path), '{s}')" for s in suffixes) + ")"


@query("p6_content_groups", duck(f"SELECT id, CASE WHEN {_like(op.INCOMPRESSIBLE)} THEN 3 WHEN {_like(op.TEXT)} THEN 0 WHEN {_like(op.CODE)} THEN 1 ELSE 2 END AS grp FROM tree"))
def p6(spark, d):
    return frame(spark, d, "tree").select("id", op.content_group(F.col("path")).alias("grp"))


_PATH = "CASE file_id % 6 WHEN 0 THEN '/' || path WHEN 1 THEN '../' || path WHEN 2 THEN './a/./' || path WHEN 3 THEN '' WHEN 4 THEN './.' ELSE path END"


def _odd_paths(spark, d):
    return _files(spark, d).select("file_id", F.expr(_PATH).alias("path"))


@query("p8_path_confinement", duck(f"SELECT file_id, reason, CASE WHEN reason IS NULL THEN array_to_string(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), '/') END AS normal FROM (SELECT file_id, p, CASE WHEN p = '' THEN 'empty' WHEN starts_with(p, '/') THEN 'absolute' WHEN list_contains(string_split(p, '/'), '..') THEN 'parent_traversal' WHEN len(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.')) = 0 THEN 'empty_normalized' END AS reason FROM (SELECT file_id, {_PATH} AS p FROM files))"))
def p8(spark, d):
    normal, reason = op.confined_path(F.col("path"))
    return _odd_paths(spark, d).select("file_id", reason.alias("reason"), normal.alias("normal"))


@query("p9_symlink_targets", duck(f"SELECT file_id, p <> '' AND NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..') AS allowed FROM (SELECT file_id, {_PATH} AS p FROM files)"))
def p9(spark, d):
    return _odd_paths(spark, d).select("file_id", op.symlink_allowed(F.col("path")).alias("allowed"))


@query("p10_safe_names", duck("SELECT file_id, regexp_replace(path, '[^A-Za-z0-9._\\-]', '_', 'g') AS name FROM files"))
def p10(spark, d):
    return _files(spark, d).select("file_id", op.safe_component(F.col("path")).alias("name"))


@query("p11_duplicate_paths", "SELECT p_name AS path, COUNT(*) AS n, string_agg(CAST(p_partkey AS STRING), ',' ORDER BY p_partkey) AS sources FROM part GROUP BY p_name HAVING COUNT(*) > 1 AND NOT bool_and(p_size % 2 = 0)")
def p11(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("path"), F.when(F.col("p_size") % 2 == 0, "directory").otherwise("regular").alias("kind"), F.col("p_partkey").alias("source"))
    return op.duplicate_paths(p)


@query("p12_repeated_ids", duck("SELECT file_id, line, COUNT(*) AS n FROM extents GROUP BY file_id, line HAVING COUNT(*) > 1"))
def p12(spark, d):
    return op.repeated(frame(spark, d, "extents"), "file_id", "line")


@query("p16_change_guard", duck("SELECT a.file_id FROM files a JOIN files b ON a.path = b.path WHERE a.size <> b.size + CASE WHEN b.file_id % 13 = 0 THEN 1 ELSE 0 END OR a.mtime <> b.mtime"))
def p16(spark, d):
    """Files whose size or time differs between plan and emission."""
    plan = _files(spark, d).select("file_id", "path", "size", "mtime")
    now = _files(spark, d).select("path", (F.col("size") + F.when(F.col("file_id") % 13 == 0, 1).otherwise(0)).alias("now"), F.col("mtime").alias("at"))
    return plan.join(now, "path").where("size <> now OR mtime <> at").select("file_id")


@query("p17_semver", duck("SELECT scenario_id, regexp_matches(v, '" + op.SEMVER + "') AS valid FROM (SELECT scenario_id, CASE scenario_id % 8 WHEN 0 THEN '1.2.3' WHEN 1 THEN 'v1.2.3' WHEN 2 THEN '1.02.3' WHEN 3 THEN '1.2' WHEN 4 THEN '1.2.3-rc.1+b.05' WHEN 5 THEN '1.2.3-01' WHEN 6 THEN '1.2.3-0a' ELSE '' END AS v FROM raw_runs)"))
def p17(spark, d):
    v = F.expr("CASE scenario_id % 8 WHEN 0 THEN '1.2.3' WHEN 1 THEN 'v1.2.3' WHEN 2 THEN '1.02.3' WHEN 3 THEN '1.2' WHEN 4 THEN '1.2.3-rc.1+b.05' WHEN 5 THEN '1.2.3-01' WHEN 6 THEN '1.2.3-0a' ELSE '' END")
    return frame(spark, d, "raw_runs").select("scenario_id", op.valid_semver(v).alias("valid"))


@query("a8_index_summary", duck("SELECT COUNT(*) AS entries, " + ", ".join(f"COUNT(*) FILTER (kind = '{k}') AS {k}" for k in ("regular", "directory", "symlink", "fifo", "char_device", "block_device")) + ", bool_or(sparse) AS has_sparse, bool_or(hardlink_key IS NOT NULL) AS has_hardlinks, bool_or(n_xattrs > 0) AS has_xattrs, CAST(SUM(size) AS BIGINT) AS bytes, (SELECT COUNT(*) FROM extents) AS extents FROM files"))
def a8(spark, d):
    return op.index_summary(_files(spark, d), frame(spark, d, "extents"))


@query("a9_codecs", duck("SELECT 'all' AS blocks, 'mixed (' || string_agg(DISTINCT codec, ', ' ORDER BY codec) || ')' AS codec FROM blocks UNION ALL SELECT 'store', 'store' UNION ALL SELECT 'no', 'none'"))
def a9(spark, d):
    """The distinct codecs of all blocks, of those of one codec, and of none."""
    b = frame(spark, d, "blocks")
    of = lambda name, rows: op.distinct_or_mixed(rows, "codec").select(F.lit(name).alias("blocks"), "codec")
    return of("all", b).unionByName(of("store", b.where("codec = 'store'"))).unionByName(of("no", b.where("codec = 'no such codec'")))


@query("a29_compression_metrics", duck("SELECT codec, CAST(SUM(raw_len) AS BIGINT) AS raw, CAST(SUM(comp_len) AS BIGINT) AS comp, round(SUM(raw_len)::DOUBLE / SUM(comp_len), 6) AS ratio, round(100 * (1 - SUM(comp_len)::DOUBLE / SUM(raw_len)), 6) AS reduction FROM blocks GROUP BY codec"))
def a29(spark, d):
    b = frame(spark, d, "blocks").groupBy("codec").agg(F.sum("raw_len").alias("raw"), F.sum("comp_len").alias("comp"))
    guard = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y)), F.lit(0.0))
    return b.select("codec", "raw", "comp", F.round(guard("raw", "comp"), 6).alias("ratio"), F.round(100 * (1 - guard("comp", "raw")), 6).alias("reduction"))


@query("u4_listing", duck("SELECT path, 'file' AS entry FROM files UNION ALL SELECT DISTINCT string_split(path, '/')[1], 'prefix' FROM files"))
def u4(spark, d):
    return op.listing(_files(spark, d))


@query("f17_metadata_states", duck("SELECT file_id, CASE WHEN kind = 'symlink' THEN 'omitted_by_profile' WHEN uname IS NOT NULL THEN 'present' ELSE 'not_present' END AS state FROM files"))
def f17(spark, d):
    return _files(spark, d).select("file_id", op.metadata_state(F.col("kind") != "symlink", F.col("uname").isNotNull()).alias("state"))


@query("f18_archive_state", duck("SELECT CASE WHEN MAX(n) = 1 THEN 'one_extent_per_file' ELSE 'fragmented' END AS state, MAX(n) AS most FROM (SELECT COUNT(*) AS n FROM extents GROUP BY file_id)"))
def f18(spark, d):
    return op.archive_state(frame(spark, d, "extents"))


@query("f19_required_metadata", "SELECT p.profile, c.class, p.profile = 'full' OR (p.profile = 'basic' AND c.class IN ('mode', 'mtime')) AS required FROM (VALUES ('full'), ('basic'), ('payload_only')) p(profile), (VALUES ('mode'), ('mtime'), ('ownership'), ('xattrs'), ('acl')) c(class)")
def f19(spark, d):
    rows = [(p, c, p == "full" or (p == "basic" and c in ("mode", "mtime"))) for p in ("full", "basic", "payload_only") for c in ("mode", "mtime", "ownership", "xattrs", "acl")]
    return spark.createDataFrame(rows, "profile string, class string, required boolean")


@query("h11_truth_view", duck(" UNION ALL ".join(f"SELECT '{c}' AS fact, CASE WHEN bool_or({x}) THEN 'present' ELSE 'not_present' END AS state FROM files" for c, x in (("ownership_names", "uname IS NOT NULL"), ("xattrs", "n_xattrs > 0"), ("sparse", "sparse"), ("hardlinks", "hardlink_key IS NOT NULL"), ("devices", "device_major IS NOT NULL")))))
def h11(spark, d):
    facts = {"ownership_names": "uname IS NOT NULL", "xattrs": "n_xattrs > 0", "sparse": "sparse", "hardlinks": "hardlink_key IS NOT NULL", "devices": "device_major IS NOT NULL"}
    one = _files(spark, d).agg(*(F.bool_or(F.expr(x)).alias(c) for c, x in facts.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("fact"), op.metadata_state(F.lit(True), F.col(c)).alias("state")) for c in facts))).alias("x")).select("x.*")


@query("h13_listing_status", duck("SELECT kind, COUNT(*) AS n, CASE WHEN COUNT(*) FILTER (size > 4000) > 0 THEN 'degraded' ELSE 'complete' END AS status FROM files GROUP BY kind"))
def h13(spark, d):
    return _files(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.when(F.count_if(F.col("size") > 4000) > 0, "degraded").otherwise("complete").alias("status"))


@query("j15_hardlink_sources", duck("SELECT f.path, f.hardlink_key, s.source, f.path = s.source AS is_source FROM files f JOIN (SELECT hardlink_key, MIN(path) AS source FROM files WHERE hardlink_key IS NOT NULL GROUP BY hardlink_key) s ON f.hardlink_key = s.hardlink_key"))
def j15(spark, d):
    return op.hardlink_sources(_files(spark, d))


@query("a32_inventory_digest", duck("SELECT dataset, sha256(string_agg(path || ':' || bytes || chr(10), '' ORDER BY path)) AS digest FROM expected GROUP BY dataset"))
def a32(spark, d):
    return op.inventory_digest(frame(spark, d, "expected"))


@query("a33_archive_identity", duck("SELECT kind, sha256(string_agg(path || chr(10), '' ORDER BY path, file_id)) AS identity FROM files GROUP BY kind"))
def a33(spark, d):
    """Digest over all paths in order; a line feed parts them, as text columns hold no zero byte."""
    x = _files(spark, d).groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("path", "file_id"))).alias("x"))
    return x.select("kind", F.sha2(F.concat(F.array_join("x.path", "\n"), F.lit("\n")).cast("binary"), 256).alias("identity"))


@query("k3_file_map", duck("SELECT f.file_id, '{\"path\":\"' || f.path || '\",\"size\":' || f.size || ',\"extents\":' || COUNT(e.block_id) || '}' AS json FROM files f LEFT JOIN extents e ON f.file_id = e.file_id GROUP BY f.file_id, f.path, f.size"))
def k3(spark, d):
    n = _files(spark, d).join(frame(spark, d, "extents").groupBy("file_id").agg(F.count("*").alias("extents")), "file_id", "left")
    return n.select("file_id", F.to_json(F.struct("path", "size", F.coalesce("extents", F.lit(0)).alias("extents"))).alias("json"))


@query("f27_path_components", duck("SELECT file_id, len(string_split(path, '/')) AS depth, string_split(path, '/')[-1] AS name FROM files"))
def f27(spark, d):
    return _files(spark, d).select("file_id", F.size(F.split("path", "/")).cast("long").alias("depth"), F.element_at(F.split("path", "/"), -1).alias("name"))


@query("w6_running_ids", duck("SELECT file_id, CAST(SUM(CASE WHEN kind = 'regular' THEN 1 ELSE 0 END) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path, file_id) AS BIGINT) AS block_id, dense_rank() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY hardlink_key) AS link_id FROM files"))
def w6(spark, d):
    """Running block ids and hard-link ids within each top directory."""
    rows = _files(spark, d).select("file_id", "path", "kind", "hardlink_key", F.split("path", "/")[0].alias("top"))
    run = ranges.running(rows, ["top"], [F.col("path"), F.col("file_id")], F.when(F.col("kind") == "regular", 1).otherwise(0), "block_id")
    return ranges.dense(run, ["top"], "hardlink_key", "link_id").select("file_id", "block_id", "link_id")
