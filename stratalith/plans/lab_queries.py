"""Experiment analytics over the bindings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..bindings import duck, frame
from ..operators import lab as op
from .registry import query


def _any(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


def _list(values) -> str:
    return ", ".join(f"('{v}')" if isinstance(v, str) else f"({v})" for v in values)


def _normal(sql: str) -> str:
    """SQL over ``norm``, the normalized runs, in terms of the raw ones."""
    return duck(f"""WITH d AS (SELECT *, lower(stdout || chr(10) || stderr) AS diag FROM raw_runs),
        s AS (SELECT *, CASE WHEN exit_code = 0 THEN 'NONE' WHEN {_any('diag', op.PRE_EXTRACT_MARKERS)} THEN 'PRE_EXTRACT' WHEN {_any('diag', op.EXTRACTION_MARKERS)} THEN 'EXTRACTION' ELSE 'UNKNOWN' END AS failure_stage,
            CASE WHEN regexp_replace(diag, '\\s', '', 'g') = '' THEN 'NONE' WHEN {_any('diag', op.PRECISE_MARKERS)} THEN 'PRECISE' WHEN {_any('diag', op.STRUCTURAL_MARKERS)} THEN 'STRUCTURAL' ELSE 'GENERIC' END AS diagnostic_specificity,
            {_any('diag', op.REFUSAL_MARKERS)} AS refusal FROM d),
        r AS (SELECT *, CASE WHEN files_expected = 0 THEN 0.0::DOUBLE ELSE least(files_recovered::DOUBLE / files_expected, 1.0) END AS rf, CASE WHEN bytes_expected = 0 THEN 0.0::DOUBLE ELSE least(bytes_recovered::DOUBLE / bytes_expected, 1.0) END AS rb FROM s),
        norm AS (SELECT scenario_id, dataset, format, corruption_type, target_class, exit_code, failure_stage, diagnostic_specificity,
            CASE WHEN exit_code = -1 THEN 'TOOL_ERROR' WHEN has_json_result AND NOT has_json_file THEN 'TOOL_ERROR' WHEN exit_code = 0 THEN 'SUCCESS' WHEN refusal AND failure_stage = 'EXTRACTION' THEN 'REFUSED'
                WHEN refusal THEN 'PARTIAL' WHEN failure_stage = 'PRE_EXTRACT' THEN 'STRUCTURAL_FAIL' WHEN failure_stage = 'EXTRACTION' THEN 'PARTIAL' ELSE 'TOOL_ERROR' END AS result_class,
            failure_stage = 'PRE_EXTRACT' AS detected_pre_extract, CASE WHEN has_json_result THEN 'structured_json_result' WHEN stderr = '' THEN 'stdout_only' ELSE 'stdout_and_stderr' END AS result_completeness,
            files_expected, least(files_recovered, files_expected) AS files_recovered, least(files_missing, files_expected - least(files_recovered, files_expected)) AS files_missing,
            bytes_expected, least(bytes_recovered, bytes_expected) AS bytes_recovered, rf AS recovery_ratio_files, rb AS recovery_ratio_bytes,
            CASE WHEN rf >= 1 THEN 'NONE' WHEN rf >= 0.9 THEN 'LOCALIZED' WHEN rf >= 0.5 THEN 'PARTIAL_SET' WHEN rf > 0 THEN 'WIDESPREAD' ELSE 'TOTAL' END AS blast_radius_class, 'FILE_AND_BYTE_COUNTS' AS recovery_evidence_strength,
            failure_stage = 'UNKNOWN' AND exit_code <> 0 AS unknown_stage_note, has_json_result AND NOT has_json_file AS missing_json_note FROM r) {sql}""")


def _norm(spark, d) -> DataFrame:
    return op.normalize(frame(spark, d, "raw_runs"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_MATRIX = f"SELECT 'p2-core-' || d || '-' || replace(f, '+', '_') || '-' || c || '-' || t || '-' || m || '-' || s AS scenario_id, d AS dataset, f AS format, c AS corruption_type, t AS target_class, m AS magnitude, b AS magnitude_bytes, s AS seed FROM (VALUES {_list(op.DATASETS)}) a(d), (VALUES {_list(op.FORMATS)}) b(f), (VALUES {_list(op.CORRUPTIONS)}) c(c), (VALUES {_list(op.TARGETS)}) e(t), (VALUES ('1B', 1), ('256B', 256), ('4KB', 4096)) g(m, b), (VALUES {_list(op.SEEDS)}) h(s)"


@query("j8_scenario_matrix", _MATRIX)
def j8(spark, d):
    return op.scenario_matrix(spark)


@query("l2_manifest", f"SELECT dataset, format, COUNT(*) AS scenarios, MIN(scenario_id) AS first_id FROM ({_MATRIX}) GROUP BY dataset, format")
def l2(spark, d):
    return op.scenario_matrix(spark).groupBy("dataset", "format").agg(F.count("*").alias("scenarios"), F.min("scenario_id").alias("first_id"))


@query("p14_locked_matrix_check", f"SELECT COUNT(*) = 2700 AS count_ok, COUNT(DISTINCT dataset) = 3 AS datasets_ok, COUNT(DISTINCT format) = 5 AS formats_ok, COUNT(DISTINCT scenario_id) = COUNT(*) AS ids_unique FROM ({_MATRIX})")
def p14(spark, d):
    return op.scenario_matrix(spark).agg((F.count("*") == 2700).alias("count_ok"), (F.countDistinct("dataset") == 3).alias("datasets_ok"), (F.countDistinct("format") == 5).alias("formats_ok"), (F.countDistinct("scenario_id") == F.count("*")).alias("ids_unique"))


@query("p15_audit_summary", duck("SELECT result, COUNT(*) AS n FROM (SELECT CASE WHEN COUNT(*) > 0 THEN 'pass' ELSE 'fail' END AS result FROM files UNION ALL SELECT CASE WHEN COUNT(*) = COUNT(DISTINCT file_id) THEN 'pass' ELSE 'fail' END FROM files UNION ALL SELECT CASE WHEN COUNT(*) = COUNT(DISTINCT file_id * 100 + line) THEN 'pass' ELSE 'fail' END FROM extents UNION ALL SELECT CASE WHEN MIN(len) > 0 THEN 'pass' ELSE 'fail' END FROM extents) GROUP BY result"))
def p15(spark, d):
    f, e = frame(spark, d, "files"), frame(spark, d, "extents")
    checks = [f.agg((F.count("*") > 0).alias("ok")), f.agg((F.count("*") == F.countDistinct("file_id")).alias("ok")), e.agg((F.count("*") == F.countDistinct(F.col("file_id") * 100 + F.col("line"))).alias("ok")), e.agg((F.min("len") > 0).alias("ok"))]
    return reduce(DataFrame.union, checks).groupBy(F.when(F.col("ok"), "pass").otherwise("fail").alias("result")).agg(F.count("*").alias("n"))


@query("l6_normalization", _normal("SELECT * REPLACE (round(recovery_ratio_files, 6) AS recovery_ratio_files, round(recovery_ratio_bytes, 6) AS recovery_ratio_bytes) FROM norm"))
def l6(spark, d):
    return _rounded(_norm(spark, d), "recovery_ratio_files", "recovery_ratio_bytes")


for _name, _column in (("f1_blast_radius", "blast_radius_class"), ("f4_failure_stage", "failure_stage"), ("f5_specificity", "diagnostic_specificity"), ("f6_result_class", "result_class"), ("f35_completeness", "result_completeness")):

    @query(_name, _normal(f"SELECT scenario_id, {_column} FROM norm"))
    def _scalar(spark, d, column=_column):
        return _norm(spark, d).select("scenario_id", column)


@query("f3_accounting_clamp", _normal("SELECT scenario_id, files_recovered, files_missing, bytes_recovered FROM norm"))
def f3(spark, d):
    return _norm(spark, d).select("scenario_id", "files_recovered", "files_missing", "bytes_recovered")


@query("f2_clamped_ratio", _normal("SELECT scenario_id, round(recovery_ratio_files, 6) AS ratio FROM norm"))
def f2(spark, d):
    return _norm(spark, d).select("scenario_id", F.round("recovery_ratio_files", 6).alias("ratio"))


@query("p7_refusal_signal", duck(f"SELECT scenario_id, {_any('lower(stdout || chr(10) || stderr)', op.REFUSAL_MARKERS)} AS refusal FROM raw_runs"))
def p7(spark, d):
    return frame(spark, d, "raw_runs").select("scenario_id", op.contains_any(op.diagnostic_text(), op.REFUSAL_MARKERS).alias("refusal"))


@query("o4_by_scenario", _normal("SELECT scenario_id, result_class FROM norm ORDER BY scenario_id"))
def o4(spark, d):
    return _norm(spark, d).select("scenario_id", "result_class").orderBy("scenario_id")


@query("p13_ratio_check", _normal("SELECT COUNT(*) AS bad FROM norm WHERE recovery_ratio_files NOT BETWEEN 0 AND 1 OR recovery_ratio_bytes NOT BETWEEN 0 AND 1 OR scenario_id IS NULL"))
def p13(spark, d):
    return _norm(spark, d).where(~F.col("recovery_ratio_files").between(0, 1) | ~F.col("recovery_ratio_bytes").between(0, 1) | F.col("scenario_id").isNull()).agg(F.count("*").alias("bad"))


@query("a1_counts", _normal(" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, COUNT(*) AS n FROM norm GROUP BY {c}" for c in ("result_class", "failure_stage", "diagnostic_specificity", "recovery_evidence_strength"))))
def a1(spark, d):
    return op.counts_by(_norm(spark, d), ["result_class", "failure_stage", "diagnostic_specificity", "recovery_evidence_strength"])


@query("a2_format_results", _normal("SELECT format, result_class, COUNT(*) AS n FROM norm GROUP BY format, result_class"))
def a2(spark, d):
    return op.two_level_counts(_norm(spark, d), "format", "result_class")


@query("a2_format_blast", _normal("SELECT format, blast_radius_class, COUNT(*) AS n FROM norm GROUP BY format, blast_radius_class"))
def a2b(spark, d):
    return op.two_level_counts(_norm(spark, d), "format", "blast_radius_class")


@query("a3_averages", _normal(" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, round(avg(recovery_ratio_files), 6) AS mean_files, round(avg(recovery_ratio_bytes), 6) AS mean_bytes FROM norm GROUP BY {c}" for c in ("format", "corruption_type", "target_class"))))
def a3(spark, d):
    n = _norm(spark, d)
    return reduce(DataFrame.unionByName, (_rounded(op.averages(n, c), "mean_files", "mean_bytes").select(F.lit(c).alias("dimension"), F.col(c).alias("value"), "mean_files", "mean_bytes") for c in ("format", "corruption_type", "target_class")))


_COMPARE = "SELECT format, COUNT(*) AS total_runs, round(avg(CASE WHEN recovery_ratio_files > 0 THEN 1.0 ELSE 0.0 END), 6) AS recovery_success_rate, round(avg(recovery_ratio_files), 6) AS mean_recovery_ratio_files, round(avg(recovery_ratio_bytes), 6) AS mean_recovery_ratio_bytes, round(avg(CASE WHEN detected_pre_extract THEN 1.0 ELSE 0.0 END), 6) AS detection_rate FROM norm GROUP BY format"


@query("a4_comparison", _normal(_COMPARE))
def a4(spark, d):
    return _rounded(op.comparison(_norm(spark, d)), "recovery_success_rate", "mean_recovery_ratio_files", "mean_recovery_ratio_bytes", "detection_rate")


@query("a5_distributions", _normal("SELECT format, diagnostic_specificity AS label, COUNT(*) AS n, round(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY format), 6) AS share FROM norm GROUP BY format, diagnostic_specificity"))
def a5(spark, d):
    return _rounded(op.distribution(_norm(spark, d), "format", "diagnostic_specificity"), "share")


def _weights(column: str, weights: dict[str, float]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 0.0 END"


@query("f7_weighted_scores", _normal(f"SELECT format, round(avg(({_weights('diagnostic_specificity', op.SPECIFICITY_WEIGHT)})::DOUBLE) / 3, 6) AS specificity, round(avg(({_weights('blast_radius_class', op.CONTAINMENT_WEIGHT)})::DOUBLE), 6) AS containment FROM norm GROUP BY format"))
def f7(spark, d):
    n = _norm(spark, d)
    a = op.weighted_score(op.distribution(n, "format", "diagnostic_specificity"), "format", op.SPECIFICITY_WEIGHT, 3.0).withColumnRenamed("score", "specificity")
    b = op.weighted_score(op.distribution(n, "format", "blast_radius_class"), "format", op.CONTAINMENT_WEIGHT, 1.0).withColumnRenamed("score", "containment")
    return _rounded(a.join(b, "format"), "specificity", "containment")


@query(
    "w1_rankings",
    _normal(f"""SELECT ranking, rank, format, round(score, 6) AS score FROM (
        SELECT 'survivability' AS ranking, ROW_NUMBER() OVER (ORDER BY sr DESC, mf DESC, mb DESC, format) AS rank, format, sr AS score FROM t
        UNION ALL SELECT 'diagnostic_quality', ROW_NUMBER() OVER (ORDER BY cp DESC, dr DESC, sp DESC, format), format, cp FROM t
        UNION ALL SELECT 'corruption_containment', ROW_NUMBER() OVER (ORDER BY ct DESC, mf DESC, format), format, ct FROM t)""").replace(
        "norm AS (", "norm AS (", 1
    ).replace(
        " SELECT ranking, rank",
        f""", u AS (SELECT format, avg(CASE WHEN recovery_ratio_files > 0 THEN 1.0 ELSE 0.0 END) sr, avg(recovery_ratio_files) mf, avg(recovery_ratio_bytes) mb, avg(CASE WHEN detected_pre_extract THEN 1.0 ELSE 0.0 END) dr,
        avg(({_weights('diagnostic_specificity', op.SPECIFICITY_WEIGHT)})::DOUBLE) / 3 sp, avg(({_weights('blast_radius_class', op.CONTAINMENT_WEIGHT)})::DOUBLE) ct FROM norm GROUP BY format),
        t AS (SELECT format, round(sr, 9) sr, round(mf, 9) mf, round(mb, 9) mb, round(dr, 9) dr, round(sp, 9) sp, round(ct, 9) ct, round((dr + sp) / 2, 9) cp FROM u) SELECT ranking, rank""",
        1,
    ),
)
def w1(spark, d):
    return _rounded(op.rankings(_norm(spark, d)), "score")


@query("f8_composite", _normal(f"SELECT format, round((avg(CASE WHEN detected_pre_extract THEN 1.0 ELSE 0.0 END) + avg(({_weights('diagnostic_specificity', op.SPECIFICITY_WEIGHT)})::DOUBLE) / 3) / 2, 6) AS composite FROM norm GROUP BY format"))
def f8(spark, d):
    n = _norm(spark, d)
    score = op.weighted_score(op.distribution(n, "format", "diagnostic_specificity"), "format", op.SPECIFICITY_WEIGHT, 3.0)
    return op.comparison(n).join(score, "format").select("format", F.round((F.col("detection_rate") + F.col("score")) / 2, 6).alias("composite"))


@query("l7_comparison_report", _normal(f"SELECT c.*, n.label, n.share FROM ({_COMPARE}) c JOIN (SELECT format, blast_radius_class AS label, round(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY format), 6) AS share FROM norm GROUP BY format, blast_radius_class) n ON c.format = n.format"))
def l7(spark, d):
    return a4(spark, d).join(_rounded(op.distribution(_norm(spark, d), "format", "blast_radius_class"), "share").drop("n"), "format")


_ACCOUNT = "SELECT e.dataset, COUNT(*) AS files_expected, COUNT(a.path) AS files_recovered, CAST(SUM(e.bytes) AS BIGINT) AS bytes_expected, CAST(COALESCE(SUM(least(a.bytes, CASE WHEN a.path IS NULL THEN NULL ELSE e.bytes END)), 0) AS BIGINT) AS bytes_recovered FROM expected e LEFT JOIN actual a ON e.path = a.path GROUP BY e.dataset"


@query("j4_recovery_accounting", duck(f"SELECT *, files_expected - files_recovered AS files_missing, round(files_recovered::DOUBLE / files_expected, 6) AS ratio_files, round(CASE WHEN bytes_expected = 0 THEN 0 ELSE bytes_recovered::DOUBLE / bytes_expected END, 6) AS ratio_bytes FROM ({_ACCOUNT})"))
def j4(spark, d):
    return _rounded(op.recovery_accounting(frame(spark, d, "expected"), frame(spark, d, "actual"), "dataset"), "ratio_files", "ratio_bytes")


@query("a7_totals", duck(f"SELECT CAST(SUM(files_expected) AS BIGINT) AS files_expected, CAST(SUM(files_recovered) AS BIGINT) AS files_recovered, CAST(SUM(bytes_recovered) AS BIGINT) AS bytes_recovered FROM ({_ACCOUNT})"))
def a7(spark, d):
    return op.recovery_accounting(frame(spark, d, "expected"), frame(spark, d, "actual"), "dataset").agg(*(F.sum(c).alias(c) for c in ("files_expected", "files_recovered", "bytes_recovered")))


@query("j5_scenario_builds", duck("SELECT r.scenario_id, b.archive_id FROM raw_runs r JOIN (SELECT dataset, format, MIN(scenario_id) AS archive_id FROM raw_runs GROUP BY dataset, format) b ON r.dataset = b.dataset AND r.format = b.format"))
def j5(spark, d):
    r = frame(spark, d, "raw_runs")
    builds = r.groupBy("dataset", "format").agg(F.min("scenario_id").alias("archive_id"))
    return r.join(builds, ["dataset", "format"]).select("scenario_id", "archive_id")


@query("j6_scenario_inventories", duck("SELECT r.scenario_id, i.files FROM raw_runs r JOIN (SELECT CASE path % 3 WHEN 0 THEN 'smallfiles' WHEN 1 THEN 'mixed' ELSE 'largefiles' END AS dataset, COUNT(*) AS files FROM expected GROUP BY 1) i ON r.dataset = i.dataset"))
def j6(spark, d):
    key = F.when(F.col("path") % 3 == 0, "smallfiles").when(F.col("path") % 3 == 1, "mixed").otherwise("largefiles")
    inventory = frame(spark, d, "expected").groupBy(key.alias("dataset")).agg(F.count("*").alias("files"))
    return frame(spark, d, "raw_runs").join(inventory, "dataset").select("scenario_id", "files")


@query("j7_completeness", "SELECT 'missing' AS finding, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT 'unexpected', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'duplicate', l_orderkey FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1")
def j7(spark, d):
    return op.completeness_audit(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id")), spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id")))


@query("u3_differences", "SELECT 'no_orders' AS finding, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'no_customer', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def u3(spark, d):
    have = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"))
    seen = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id"))
    return have.subtract(seen).select(F.lit("no_orders").alias("finding"), "id").union(seen.subtract(have).select(F.lit("no_customer").alias("finding"), "id"))


@query("a6_execution_report", duck("SELECT c.dimension, c.value, c.n, f.first_version FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS STRING) AS value, COUNT(*) AS n FROM raw_runs GROUP BY {c}" for c in ("format", "dataset", "exit_code", "has_json_result")) + ") c LEFT JOIN (SELECT format, arg_min(tool_version, scenario_id) AS first_version FROM raw_runs WHERE tool_version IS NOT NULL GROUP BY format) f ON c.dimension = 'format' AND c.value = f.format"))
def a6(spark, d):
    return op.execution_report(frame(spark, d, "raw_runs"))


@query("f26_scenario_ids", f"SELECT scenario_id FROM ({_MATRIX}) WHERE seed = 1337")
def f26(spark, d):
    return op.scenario_matrix(spark).where("seed = 1337").select("scenario_id")


def _outcome(p: str) -> str:
    return f"CASE WHEN {p}exported_full_file_count > 0 THEN 'FULL_FILE_SALVAGE_AVAILABLE' WHEN {p}salvageable_file_count > 0 THEN 'PARTIAL_FILE_SALVAGE' WHEN {p}verified_block_count > 0 THEN 'ORPHAN_EVIDENCE_ONLY' ELSE 'NO_VERIFIED_EVIDENCE' END"


def _rank(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{o}' THEN {i}" for i, o in enumerate(op.OUTCOMES)) + " ELSE -1 END"


_PAIRS = f"""(SELECT o.scenario_id, o.dataset, o.corruption_target, {", ".join(f"CAST({v[0]}.{m} AS BIGINT) AS {v}_{m}" for v in ("old", "new") for m in op.METRICS)}, {_outcome("o.")} AS old_outcome, {_outcome("n.")} AS new_outcome
    FROM ab o JOIN ab n ON o.scenario_id = n.scenario_id WHERE o.variant = 'old' AND n.variant = 'new')"""
_CHANGE = f"""CASE WHEN old_outcome = '{op.OUTCOMES[1]}' AND new_outcome = '{op.OUTCOMES[2]}' THEN 'IMPROVED_ORPHAN_TO_PARTIAL' WHEN old_outcome = '{op.OUTCOMES[1]}' AND new_outcome = '{op.OUTCOMES[3]}' THEN 'IMPROVED_ORPHAN_TO_FULL'
    WHEN old_outcome = '{op.OUTCOMES[0]}' AND new_outcome = '{op.OUTCOMES[2]}' THEN 'IMPROVED_NONE_TO_PARTIAL' WHEN old_outcome = '{op.OUTCOMES[0]}' AND new_outcome = '{op.OUTCOMES[3]}' THEN 'IMPROVED_NONE_TO_FULL'
    WHEN {_rank('new_outcome')} > {_rank('old_outcome')} THEN 'IMPROVED_OTHER' WHEN {_rank('new_outcome')} < {_rank('old_outcome')} THEN 'DEGRADED' ELSE 'UNCHANGED' END"""


def _pairs(spark, d) -> DataFrame:
    return op.pair_variants(frame(spark, d, "ab"))


@query("j14_ab_pairs", duck(f"SELECT scenario_id, old_outcome, new_outcome, {_CHANGE} AS change FROM {_PAIRS}"))
def j14(spark, d):
    return _pairs(spark, d).select("scenario_id", "old_outcome", "new_outcome", "change")


@query("f10_improvement_classes", duck(f"SELECT {_CHANGE} AS change, COUNT(*) AS n FROM {_PAIRS} GROUP BY 1"))
def f10(spark, d):
    return _pairs(spark, d).groupBy("change").agg(F.count("*").alias("n"))


for _by in ("dataset", "corruption_target"):

    @query(f"a15_deltas_by_{_by}", duck(f"SELECT {_by}, COUNT(*) AS scenarios, {', '.join(f'CAST(SUM(new_{m} - old_{m}) AS BIGINT) AS delta_{m}' for m in op.METRICS)} FROM {_PAIRS} GROUP BY {_by}"))
    def _deltas(spark, d, by=_by):
        return op.delta_groups(_pairs(spark, d), by)


@query("a15_outcome_pivot", duck(f"SELECT dataset, {', '.join(f'COUNT(*) FILTER (new_outcome = {chr(39)}{o}{chr(39)}) AS {o.lower()}' for o in op.OUTCOMES)} FROM {_PAIRS} GROUP BY dataset"))
def a15p(spark, d):
    return op.outcome_pivot(_pairs(spark, d), "dataset", "new_outcome")


@query("a16_value_counts", duck(f"SELECT old_outcome, COUNT(*) AS n FROM {_PAIRS} GROUP BY old_outcome"))
def a16(spark, d):
    return _pairs(spark, d).groupBy("old_outcome").agg(F.count("*").alias("n"))


@query("a34_improvement_counters", duck(f"SELECT COUNT(*) FILTER (a <= 1 AND b >= 2) AS raised, COUNT(*) FILTER (b > a) AS improved, COUNT(*) FILTER (b < a) AS degraded, COUNT(*) FILTER (a = b) AS unchanged FROM (SELECT {_rank('old_outcome')} a, {_rank('new_outcome')} b FROM {_PAIRS})"))
def a34(spark, d):
    return op.improvement_counters(_pairs(spark, d))


@query("f9_outcomes", duck(f"SELECT archive_id, {_outcome('')} AS outcome FROM experiments"))
def f9(spark, d):
    return frame(spark, d, "experiments").select("archive_id", op.outcome(F.col("exported_full_file_count"), F.col("salvageable_file_count"), F.col("verified_block_count")).alias("outcome"))


_SUMS = ["verified_block_count", "salvageable_file_count", "unsalvageable_file_count", "exported_block_count", "exported_extent_count"]


@query("a12_outcome_rollup", duck(f"SELECT o.outcome, COUNT(e.archive_id) AS runs, MIN(e.archive_id) AS first_id, MAX(e.archive_id) AS last_id, {', '.join(f'CAST(COALESCE(SUM(e.{c}), 0) AS BIGINT) AS {c}' for c in _SUMS)} FROM (VALUES {_list(op.OUTCOMES)}) o(outcome) LEFT JOIN (SELECT *, {_outcome('')} AS outcome FROM experiments) e ON o.outcome = e.outcome GROUP BY o.outcome"))
def a12(spark, d):
    return op.outcome_rollup(frame(spark, d, "experiments"))


@query("a13_profile_rollup", duck(f"SELECT upper(regexp_extract(lower(archive_path), '_profile_([^._\\-]+)', 1)) AS profile, {', '.join(f'COUNT(*) FILTER (outcome = {chr(39)}{o}{chr(39)}) AS {o.lower()}' for o in op.OUTCOMES)} FROM (SELECT *, {_outcome('')} AS outcome FROM experiments) GROUP BY 1"))
def a13(spark, d):
    e = frame(spark, d, "experiments").select(op.profile_key(F.col("archive_path")).alias("profile"), op.outcome(F.col("exported_full_file_count"), F.col("salvageable_file_count"), F.col("verified_block_count")).alias("outcome"))
    return op.outcome_pivot(e, "profile", "outcome")


@query("f16_profile_keys", duck("SELECT archive_id, CASE WHEN archive_id % 5 = 4 THEN 'UNKNOWN_PROFILE' ELSE upper(regexp_extract(lower(archive_path), '_profile_([^._\\-]+)', 1)) END AS profile FROM experiments"))
def f16(spark, d):
    """Keys after each of the four markers, and where there is none."""
    path = F.expr("CASE archive_id % 5 WHEN 0 THEN archive_path WHEN 1 THEN replace(archive_path, '_profile_', '-profile-') WHEN 2 THEN replace(archive_path, '_profile_', '_damage_') WHEN 3 THEN replace(archive_path, '_profile_', '-damage-') ELSE replace(archive_path, '_profile_', '_') END")
    return frame(spark, d, "experiments").select("archive_id", op.profile_key(path).alias("profile"))


@query("a14_experiment_totals", duck(f"SELECT COUNT(*) AS runs, COUNT(*) FILTER (verified_block_count > 0) AS with_blocks, COUNT(*) FILTER (salvageable_file_count > 0) AS with_files, COUNT(*) FILTER (exported_full_file_count > 0) AS with_full, {', '.join(f'CAST(SUM({c}) AS BIGINT) AS {c}' for c in _SUMS)} FROM experiments"))
def a14(spark, d):
    e = frame(spark, d, "experiments")
    return e.agg(F.count("*").alias("runs"), F.count_if(F.col("verified_block_count") > 0).alias("with_blocks"), F.count_if(F.col("salvageable_file_count") > 0).alias("with_files"), F.count_if(F.col("exported_full_file_count") > 0).alias("with_full"), *(F.sum(c).cast("long").alias(c) for c in _SUMS))


@query("o6_top_runs", duck("SELECT archive_id, CAST(verified_block_count AS BIGINT) AS blocks FROM experiments ORDER BY verified_block_count DESC, archive_id LIMIT 5"))
def o6(spark, d):
    """A top-five report."""
    return frame(spark, d, "experiments").orderBy(F.col("verified_block_count").desc(), "archive_id").limit(5).select("archive_id", F.col("verified_block_count").cast("long").alias("blocks"))


@query("o6_top_orphans", duck("SELECT archive_id, CAST(verified_block_count AS BIGINT) AS blocks FROM experiments WHERE exported_full_file_count = 0 AND salvageable_file_count = 0 AND verified_block_count > 0 ORDER BY verified_block_count DESC, archive_id LIMIT 5"))
def o6b(spark, d):
    e = frame(spark, d, "experiments").where("exported_full_file_count = 0 AND salvageable_file_count = 0 AND verified_block_count > 0")
    return e.orderBy(F.col("verified_block_count").desc(), "archive_id").limit(5).select("archive_id", F.col("verified_block_count").cast("long").alias("blocks"))


@query("h7_artifact_counts", duck("SELECT archive_id, CAST(exported_block_count AS BIGINT) AS blocks, CAST(exported_extent_count AS BIGINT) AS extents FROM experiments"))
def h7(spark, d):
    """Counts as sizes of arrays of artifacts."""
    items = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(1), F.col(c).cast("int"))).otherwise(F.array().cast("array<int>"))
    return frame(spark, d, "experiments").select("archive_id", F.size(items("exported_block_count")).cast("long").alias("blocks"), F.size(items("exported_extent_count")).cast("long").alias("extents"))


@query("a17_class_counts_merge", duck("SELECT class, COUNT(*) AS n FROM variants GROUP BY class"))
def a17(spark, d):
    """Sum of per-scenario maps of class counts, key by key."""
    maps = frame(spark, d, "variants").select(F.create_map("class", F.lit(1).cast("long")).alias("m"))
    return maps.select(F.explode("m")).groupBy(F.col("key").alias("class")).agg(F.sum("value").alias("n"))


@query("h8_class_histogram", duck("SELECT variant, class, COUNT(*) AS n FROM variants GROUP BY variant, class"))
def h8(spark, d):
    return op.two_level_counts(frame(spark, d, "variants"), "variant", "class")


_NAMES = [n for _, ns in op.CLASS_RANKS for n in ns]


def _best(prefix: str = "") -> str:
    return "CASE " + " ".join(f"WHEN {' + '.join(f'COUNT(*) FILTER (class = {chr(39)}{n}{chr(39)})' for n in ns)} > 0 THEN '{label}'" for label, ns in op.CLASS_RANKS) + " ELSE 'none' END"


@query("a18_class_deltas", duck("SELECT k.class, COALESCE(b.n, 0) - COALESCE(a.n, 0) AS delta FROM (SELECT DISTINCT class FROM variants) k LEFT JOIN (SELECT class, COUNT(*) n FROM variants WHERE variant = 'payload_only' GROUP BY class) a ON k.class = a.class LEFT JOIN (SELECT class, COUNT(*) n FROM variants WHERE variant = 'full' GROUP BY class) b ON k.class = b.class"))
def a18(spark, d):
    count = lambda v: F.count_if(F.col("variant") == v)
    return frame(spark, d, "variants").groupBy("class").agg((count("full") - count("payload_only")).alias("delta"))


@query("a35_class_deltas_ranked", duck("SELECT label, COUNT(*) FILTER (variant = 'path_dict') - COUNT(*) FILTER (variant = 'manifest') AS delta FROM (SELECT variant, " + "CASE " + " ".join(f"WHEN class IN ({', '.join(f'{chr(39)}{n}{chr(39)}' for n in ns)}) THEN '{label}'" for label, ns in op.CLASS_RANKS) + " ELSE 'none' END AS label FROM variants) GROUP BY label"))
def a35(spark, d):
    label = F.lit("none")
    for name, names in reversed(op.CLASS_RANKS):
        label = F.when(F.col("class").isin(names), name).otherwise(label)
    return frame(spark, d, "variants").groupBy(label.alias("label")).agg((F.count_if(F.col("variant") == "path_dict") - F.count_if(F.col("variant") == "manifest")).alias("delta"))


@query("a19_nested_groups", duck(f"SELECT target, COUNT(*) AS n, {', '.join(f'COUNT(*) FILTER (class = {chr(39)}{n}{chr(39)}) AS {n}' for n in _NAMES)}, {_best()} AS best FROM variants GROUP BY target"))
def a19(spark, d):
    return op.class_histogram(frame(spark, d, "variants"), "target")


@query("f11_best_class", duck(f"SELECT extents_per_file, {_best()} AS best FROM variants GROUP BY extents_per_file"))
def f11(spark, d):
    return op.class_histogram(frame(spark, d, "variants"), "extents_per_file").select("extents_per_file", "best")


@query("f12_fail_closed", duck("SELECT scenario_id, CASE WHEN class IN ('FULL_VERIFIED', 'FULL_NAMED_VERIFIED') THEN CASE WHEN variant = 'path_dict' AND (paths = 0 OR manifests = 1) THEN 'anonymous' ELSE 'named' END ELSE 'other' END AS rank FROM variants"))
def f12(spark, d):
    v = frame(spark, d, "variants")
    rank = F.when(F.col("class").isin("FULL_VERIFIED", "FULL_NAMED_VERIFIED"), "named").otherwise("other")
    name = F.when(F.col("variant") == "path_dict", "extent_identity_path_dict_single").otherwise(F.col("variant"))
    return v.select("scenario_id", op.fail_closed(name, rank, F.col("paths"), F.col("manifests") == 1).alias("rank"))


@query("f14_buckets", duck("SELECT scenario_id, CASE WHEN path_length >= 180 THEN 'very_long' WHEN path_length >= 120 THEN 'long' ELSE 'normal' END AS path_bucket, CASE WHEN extents_per_file >= 32 THEN 'extreme_fragmentation' WHEN extents_per_file >= 8 THEN 'fragmented' ELSE 'low_fragmentation' END AS density_bucket FROM variants"))
def f14(spark, d):
    return frame(spark, d, "variants").select("scenario_id", op.path_bucket(F.col("path_length")).alias("path_bucket"), op.density_bucket(F.col("extents_per_file")).alias("density_bucket"))


_ROLL = "SELECT variant, COUNT(*) AS scenarios, CAST(SUM(archive_bytes) AS BIGINT) AS bytes, COUNT(*) FILTER (class IN ('FULL_VERIFIED', 'FULL_NAMED_VERIFIED')) AS named FROM variants GROUP BY variant"


@query("a20_baseline_deltas", duck(f"SELECT r.*, r.bytes - b.bytes AS delta_bytes, r.named - b.named AS delta_named FROM ({_ROLL}) r CROSS JOIN (SELECT * FROM ({_ROLL}) WHERE variant = 'payload_only') b"))
def a20(spark, d):
    return op.variant_rollup(frame(spark, d, "variants"), "payload_only").drop("named_per_kib")


@query("a21_cost_ratios", duck(f"SELECT r.variant, round(CASE WHEN r.bytes > b.bytes THEN (r.named - b.named) / ((r.bytes - b.bytes) / 1024.0) ELSE 0 END, 6) AS named_per_kib FROM ({_ROLL}) r CROSS JOIN (SELECT * FROM ({_ROLL}) WHERE variant = 'payload_only') b"))
def a21(spark, d):
    return op.variant_rollup(frame(spark, d, "variants"), "payload_only").select("variant", F.round("named_per_kib", 6).alias("named_per_kib"))


_PB = "CASE WHEN path_length >= 180 THEN 'very_long' WHEN path_length >= 120 THEN 'long' ELSE 'normal' END"
_DB = "CASE WHEN extents_per_file >= 32 THEN 'extreme_fragmentation' WHEN extents_per_file >= 8 THEN 'fragmented' ELSE 'low_fragmentation' END"


@query("a22_breakdowns", duck(" UNION ALL ".join(f"SELECT '{k}' AS field, {x} AS key, variant, COUNT(*) AS n, COUNT(*) FILTER (class IN ('FULL_VERIFIED', 'FULL_NAMED_VERIFIED')) AS named FROM variants GROUP BY 2, 3" for k, x in (("dataset", "dataset"), ("target", "target"), ("path_bucket", _PB), ("density_bucket", _DB)))))
def a22(spark, d):
    return op.breakdowns(frame(spark, d, "variants"), {"dataset": F.col("dataset"), "target": F.col("target"), "path_bucket": op.path_bucket(F.col("path_length")), "density_bucket": op.density_bucket(F.col("extents_per_file"))})


@query("a23_mean_max", duck("SELECT variant, round(COALESCE(avg(path_length), 0), 6) AS mean_path, CAST(COALESCE(max(extents_per_file), 0) AS BIGINT) AS max_extents FROM variants GROUP BY variant"))
def a23(spark, d):
    return frame(spark, d, "variants").groupBy("variant").agg(F.round(F.coalesce(F.avg("path_length"), F.lit(0.0)), 6).alias("mean_path"), F.coalesce(F.max("extents_per_file"), F.lit(0)).cast("long").alias("max_extents"))


@query("a24_extent_histogram", duck("SELECT extents, COUNT(*) AS files FROM (SELECT file_id, COUNT(*) AS extents FROM extents GROUP BY file_id) GROUP BY extents"))
def a24(spark, d):
    return op.stress_stats(frame(spark, d, "extents"), "file_id")


@query("a25_dictionary_stats", duck("SELECT COUNT(*) AS entries, CAST(SUM(length(path)) AS BIGINT) AS bytes, COUNT(DISTINCT dir_id) AS directories, round(avg(length(path)), 6) AS avg_bytes, MAX(length(path)) AS longest FROM paths WHERE digest_ok"))
def a25(spark, d):
    return frame(spark, d, "paths").where("digest_ok").agg(F.count("*").alias("entries"), F.sum(F.length("path")).alias("bytes"), F.countDistinct("dir_id").alias("directories"), F.round(F.avg(F.length("path")), 6).alias("avg_bytes"), F.max(F.length("path")).alias("longest"))


@query("a36_metadata_failures", duck("SELECT COUNT(*) FILTER (manifests = 0) AS no_manifest, COUNT(*) FILTER (paths = 0) AS no_path, COUNT(*) FILTER (manifests + paths = 0) AS no_any FROM variants"))
def a36(spark, d):
    return frame(spark, d, "variants").agg(F.count_if(F.col("manifests") == 0).alias("no_manifest"), F.count_if(F.col("paths") == 0).alias("no_path"), F.count_if(F.col("manifests") + F.col("paths") == 0).alias("no_any"))


_GAIN = "SELECT scenario_id, variant, CASE WHEN variant = 'payload_only' THEN 'baseline' WHEN own IS NULL THEN 'unknown' WHEN own = class THEN 'unchanged' ELSE own || '->' || class END AS gain FROM (SELECT *, MAX(CASE WHEN variant = 'payload_only' THEN class END) OVER (PARTITION BY dataset, target, extents_per_file) AS own FROM variants)"


@query("j16_baseline_gain", duck(_GAIN))
def j16(spark, d):
    return op.baseline_gain(frame(spark, d, "variants"), ["dataset", "target", "extents_per_file"], "variant", "payload_only", "class").select("scenario_id", "variant", "gain")


@query("a37_gain_distribution", duck(f"SELECT variant, gain, COUNT(*) AS n FROM ({_GAIN}) GROUP BY variant, gain"))
def a37(spark, d):
    return j16(spark, d).groupBy("variant", "gain").agg(F.count("*").alias("n"))


@query("j17_side_by_side", duck("SELECT extents_per_file, " + ", ".join(f"MAX(class) FILTER (variant = '{v}') AS {v}" for v in ("payload_only", "full", "manifest", "path_dict")) + " FROM variants GROUP BY extents_per_file"))
def j17(spark, d):
    return op.side_by_side(frame(spark, d, "variants"), "extents_per_file", ["payload_only", "full", "manifest", "path_dict"], "class")


@query("f15_logical_keys", duck("SELECT file_id, path AS logical FROM files"))
def f15(spark, d):
    named = frame(spark, d, "files").withColumn("path", F.concat("path", F.when(F.col("file_id") % 3 == 0, "__frag_007").when(F.col("file_id") % 3 == 1, "_fragment_12").otherwise("")))
    return named.select("file_id", op.logical_key(F.col("path")).alias("logical"))
