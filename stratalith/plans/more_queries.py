"""Record scans, dictionaries, layout plans and composite reports over the bindings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..bindings import duck, frame
from ..operators import catalog, lab, ranges, salvage
from .registry import query

# Expected dictionary copies and conflict by layout and damaged target.
DICTIONARY_STATES = [
    (v, t, n, c)
    for v in ("extent_identity_path_dict_header_tail", "extent_identity_path_dict_factored_header_tail")
    for t, n, c in (("primary_dictionary", 1, False), ("mirrored_dictionary", 1, False), ("both_dictionaries", 0, False), ("inconsistent_dictionaries", 2, True))
] + [("extent_identity_path_dict_single", t, 0, False) for t in ("primary_dictionary", "mirrored_dictionary", "both_dictionaries", "inconsistent_dictionaries")]
_STATES = ", ".join(f"('{v}', '{t}', {n}, {str(c).lower()})" for v, t, n, c in DICTIONARY_STATES)


@query("f13_dictionary_states", f"SELECT variant, target, COALESCE(n, 0) AS copies, COALESCE(c, false) AS conflict FROM (SELECT DISTINCT v AS variant, x.target FROM (VALUES ('payload_only'), ('extent_identity_path_dict_single'), ('extent_identity_path_dict_header_tail'), ('extent_identity_path_dict_factored_header_tail')) a(v), (VALUES ('primary_dictionary'), ('mirrored_dictionary'), ('both_dictionaries'), ('inconsistent_dictionaries')) x(target)) LEFT JOIN (VALUES {_STATES}) s(sv, st, n, c) ON variant = sv AND target = st")
def f13(spark, d):
    """A lookup table; layouts it does not hold have no copy and no conflict."""
    table = spark.createDataFrame(DICTIONARY_STATES, "variant string, target string, copies int, conflict boolean")
    cases = spark.createDataFrame([(v,) for v in ("payload_only", "extent_identity_path_dict_single", "extent_identity_path_dict_header_tail", "extent_identity_path_dict_factored_header_tail")], "variant string")
    cases = cases.withColumn("target", F.explode(F.array(*map(F.lit, ("primary_dictionary", "mirrored_dictionary", "both_dictionaries", "inconsistent_dictionaries")))))
    return cases.join(F.broadcast(table), ["variant", "target"], "left").select("variant", "target", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


@query("f33_archive_ids", duck("SELECT archive_id, regexp_extract(archive_path, '([^/]+)$', 1) || '-' || substr(sha256(archive_path), 1, 12) AS label FROM experiments"))
def f33(spark, d):
    p = F.col("archive_path")
    return frame(spark, d, "experiments").select("archive_id", F.concat(F.substring_index(p, "/", -1), F.lit("-"), F.substring(F.sha2(p.cast("binary"), 256), 1, 12)).alias("label"))


@query("f36_label_maps", duck("SELECT scenario_id, CASE corruption_type WHEN 'bit_flip' THEN 'Bit flip' WHEN 'byte_overwrite' THEN 'Byte overwrite' WHEN 'zero_fill' THEN 'Zero fill' WHEN 'truncation' THEN 'Truncation' ELSE 'Tail damage' END AS label FROM raw_runs"))
def f36(spark, d):
    """Labels from a literal map."""
    labels = {c: c.replace("_", " ").capitalize() for c in lab.CORRUPTIONS}
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return frame(spark, d, "raw_runs").select("scenario_id", table[F.col("corruption_type")].alias("label"))


@query("w10_fixed_ordinals", duck("SELECT file_id, ordinal FROM (SELECT file_id, ordinal, COUNT(*) OVER (PARTITION BY file_id) AS n FROM extents) WHERE ordinal IN (0, n // 2, n - 1)"))
def w10(spark, d):
    """First, middle and last ordinal of each file: the fixed spread."""
    n = F.count("*").over(Window.partitionBy("file_id"))
    return frame(spark, d, "extents").withColumn("n", n).where(F.col("ordinal").isin(0) | (F.col("ordinal") == F.floor(F.col("n") / 2)) | (F.col("ordinal") == F.col("n") - 1)).select("file_id", "ordinal")


_SCHEMA = "schema string, k long, path string"


@query("s10_record_scan", "SELECT event_id, CASE CAST(json_extract(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'extent' WHEN 1 THEN 'manifest' ELSE 'path' END AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def s10(spark, d):
    """JSON records, read with one explicit schema and told apart by a discriminator."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("r", F.from_json("props", _SCHEMA))
    kind = F.when(F.col("r.k") % 3 == 0, "extent").when(F.col("r.k") % 3 == 1, "manifest").otherwise("path")
    return e.where(F.col("r.k").isNotNull()).select("event_id", kind.alias("kind"), F.col("r.k").alias("k"))


@query("h2_record_projection", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS size FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 1")
def h2(spark, d):
    return s10(spark, d).where("kind = 'manifest'").select("event_id", F.col("k").alias("size"))


@query("h1_ledger_rows", duck("SELECT f.file_id, f.path, f.size, e.block_id, e.len FROM files f JOIN extents e ON f.file_id = e.file_id"))
def h1(spark, d):
    """Files to canonical JSON and back: schema check, non-empty paths, extents exploded."""
    e = frame(spark, d, "extents").groupBy("file_id").agg(F.collect_list(F.struct("block_id", "len")).alias("extents"))
    text = frame(spark, d, "files").join(e, "file_id").select(F.to_json(F.struct("extents", "file_id", "path", "size")).alias("json"))
    parsed = text.select(F.from_json("json", "extents array<struct<block_id: long, len: long>>, file_id long, path string, size long").alias("r")).where("r.path <> ''")
    return parsed.select("r.file_id", "r.path", "r.size", F.explode("r.extents").alias("x")).select("file_id", "path", "size", "x.block_id", "x.len")


@query("v14_pack_layout", duck("SELECT f.path, COALESCE(s.source, f.path) AS payload_of, f.hardlink_key IS NULL OR f.path = s.source AS emits_block FROM files f LEFT JOIN (SELECT hardlink_key, MIN(path) AS source FROM files WHERE hardlink_key IS NOT NULL GROUP BY hardlink_key) s ON f.hardlink_key = s.hardlink_key WHERE f.kind = 'regular'"))
def v14(spark, d):
    """Regular files with the path whose payload they share; a hard link's payload is written once."""
    f = frame(spark, d, "files")
    linked = catalog.hardlink_sources(f).select("path", "source", "is_source")
    return f.where("kind = 'regular'").select("path").join(linked, "path", "left").select("path", F.coalesce("source", "path").alias("payload_of"), F.coalesce("is_source", F.lit(True)).alias("emits_block"))


@query("v15_path_dictionary", duck("SELECT split_part(path, '/', 1) AS dir, CAST(dense_rank() OVER (ORDER BY split_part(path, '/', 1)) - 1 AS BIGINT) AS dir_id, COUNT(*) AS entries FROM files GROUP BY split_part(path, '/', 1)"))
def v15(spark, d):
    """Directories of a factored dictionary with dense ids in order."""
    dirs = frame(spark, d, "files").groupBy(F.split("path", "/")[0].alias("dir")).agg(F.count("*").alias("entries"))
    return ranges.place(dirs, [], [F.col("dir")], "place").select("dir", (F.col("place") - 1).alias("dir_id"), "entries")


@query("h12_listing_fallback", duck("SELECT kind, CASE WHEN kind IN ('regular', 'directory') THEN 'index' ELSE 'footer' END AS source, COUNT(*) AS n FROM files GROUP BY kind"))
def h12(spark, d):
    """Listings from the index, or from the footer where the index has nothing."""
    f = frame(spark, d, "files").select("kind", "path")
    rows = salvage.first_source([f.where("kind IN ('regular', 'directory')"), f], "kind")
    return rows.groupBy("kind", F.when(F.col("priority") == 0, "index").otherwise("footer").alias("source")).agg(F.count("*").alias("n"))


@query("h18_tool_versions", duck("SELECT scenario_id, CAST(split_part(tool_version, '.', 1) AS BIGINT) AS major, CAST(split_part(tool_version, '.', 2) AS BIGINT) AS minor FROM raw_runs WHERE tool_version IS NOT NULL"))
def h18(spark, d):
    v = F.concat(F.lit("tool v"), "tool_version", F.lit(" (build)"))
    part = lambda k: F.regexp_extract(v, r"v(\d+)\.(\d+)\.", k).cast("long")
    return frame(spark, d, "raw_runs").where("tool_version IS NOT NULL").select("scenario_id", part(1).alias("major"), part(2).alias("minor"))


@query("h27_cohorts", duck("SELECT dataset, scenario_id, CASE dataset WHEN 'mixed' THEN 'global' ELSE dataset END AS cohort FROM raw_runs"))
def h27(spark, d):
    table = spark.createDataFrame([("smallfiles", "smallfiles"), ("largefiles", "largefiles")], "dataset string, cohort string")
    return frame(spark, d, "raw_runs").join(F.broadcast(table), "dataset", "left").select("dataset", "scenario_id", F.coalesce("cohort", F.lit("global")).alias("cohort"))


@query("h29_fingerprints", duck("SELECT scenario_id, sha256('{\"dataset\":\"' || dataset || '\",\"format\":\"' || format || '\",\"seed\":' || (scenario_id % 3) || '}') AS fingerprint FROM raw_runs"))
def h29(spark, d):
    """Digest of canonical JSON: fields are declared in key order."""
    body = F.to_json(F.struct("dataset", "format", (F.col("scenario_id") % 3).alias("seed")))
    return frame(spark, d, "raw_runs").select("scenario_id", F.sha2(body.cast("binary"), 256).alias("fingerprint"))


@query("l3_foundation", duck("SELECT r.dataset, r.format, COUNT(DISTINCT r.scenario_id) AS runs, i.digest FROM raw_runs r JOIN (SELECT CASE path % 3 WHEN 0 THEN 'smallfiles' WHEN 1 THEN 'mixed' ELSE 'largefiles' END AS dataset, sha256(string_agg(path || ':' || bytes || chr(10), '' ORDER BY path)) AS digest FROM expected GROUP BY 1) i ON r.dataset = i.dataset GROUP BY r.dataset, r.format, i.digest"))
def l3(spark, d):
    """Datasets by format with the digest of each dataset's inventory."""
    key = F.when(F.col("path") % 3 == 0, "smallfiles").when(F.col("path") % 3 == 1, "mixed").otherwise("largefiles")
    digests = catalog.inventory_digest(frame(spark, d, "expected").withColumn("dataset", key))
    return frame(spark, d, "raw_runs").groupBy("dataset", "format").agg(F.countDistinct("scenario_id").alias("runs")).join(digests, "dataset").select("dataset", "format", "runs", "digest")


@query("l8_experiment_summary", duck("SELECT outcome, COUNT(*) AS runs, CAST(SUM(verified_block_count) AS BIGINT) AS blocks FROM (SELECT *, CASE WHEN exported_full_file_count > 0 THEN 'FULL_FILE_SALVAGE_AVAILABLE' WHEN salvageable_file_count > 0 THEN 'PARTIAL_FILE_SALVAGE' WHEN verified_block_count > 0 THEN 'ORPHAN_EVIDENCE_ONLY' ELSE 'NO_VERIFIED_EVIDENCE' END AS outcome FROM experiments) GROUP BY outcome"))
def l8(spark, d):
    return lab.outcome_rollup(frame(spark, d, "experiments")).where("runs > 0").select("outcome", "runs", F.col("verified_block_count").alias("blocks"))


@query("l9_delta_invariant", duck("SELECT CAST(SUM(CASE variant WHEN 'new' THEN verified_block_count ELSE -verified_block_count END) AS BIGINT) AS delta FROM ab WHERE scenario_id IN (SELECT scenario_id FROM ab GROUP BY scenario_id HAVING COUNT(*) = 2)"))
def l9(spark, d):
    """The deltas of all groups add up to that of the rows."""
    return lab.delta_groups(lab.pair_variants(frame(spark, d, "ab")), "dataset").agg(F.sum("delta_verified_block_count").alias("delta"))
