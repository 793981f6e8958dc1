"""Experiment analytics: scenario matrix, accounting, normalization, comparison, rankings, deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The locked dimensions of the scenario matrix.
DATASETS = ["smallfiles", "mixed", "largefiles"]
FORMATS = ["native", "zip", "tar+zstd", "tar+gz", "tar+xz"]
CORRUPTIONS = ["bit_flip", "byte_overwrite", "zero_fill", "truncation", "tail_damage"]
TARGETS = ["header", "index", "payload", "tail"]
MAGNITUDES = [("1B", 1), ("256B", 256), ("4KB", 4096)]
SEEDS = [1337, 2600, 65535]
# Diagnostic markers, searched in lower-cased output.
REFUSAL_MARKERS = ["refused", "refusal", "cannot inflate", "invalid compressed data to inflate", "skipping to next header", "expected "]
PRE_EXTRACT_MARKERS = [
    "bad footer magic", "bad magic", "hash mismatch", "missing end signature", "not a zip file", "not in gzip format", "file format not recognized",
    "unsupported format", "unknown header", "this does not look like a tar archive", "premature end", "unexpected end of file", "unexpected end of input",
]
EXTRACTION_MARKERS = ["invalid compressed data to inflate", "skipping to next header", "bad zipfile offset", "crc error", "length error", "format violated", "filename too long"]
PRECISE_MARKERS = ["payload/", "bin/", "cfg/", "file #", "inflate", "idx3", "ftr4", "header"]
STRUCTURAL_MARKERS = ["magic", "archive", "format", "checksum", "crc", "corrupt", "hash mismatch", "premature end", "unexpected end", "footer", "index"]
# Weights of diagnostic specificity and of blast radius classes.
SPECIFICITY_WEIGHT = {"NONE": 0.0, "GENERIC": 1.0, "STRUCTURAL": 2.0, "PRECISE": 3.0}
CONTAINMENT_WEIGHT = {"NONE": 1.0, "LOCALIZED": 0.75, "PARTIAL_SET": 0.5, "WIDESPREAD": 0.25, "TOTAL": 0.0}
# Outcomes from worst to best.
OUTCOMES = ["NO_VERIFIED_EVIDENCE", "ORPHAN_EVIDENCE_ONLY", "PARTIAL_FILE_SALVAGE", "FULL_FILE_SALVAGE_AVAILABLE"]
# Both spellings of recovery classes, from best to worst.
CLASS_RANKS = [
    ("named", ["FULL_NAMED_VERIFIED", "FULL_VERIFIED"]), ("anonymous", ["FULL_ANONYMOUS_VERIFIED", "FULL_ANONYMOUS"]), ("partial_ordered", ["PARTIAL_ORDERED_VERIFIED", "PARTIAL_ORDERED"]),
    ("partial_unordered", ["PARTIAL_UNORDERED_VERIFIED", "PARTIAL_UNORDERED"]), ("orphan", ["ORPHAN_EVIDENCE_ONLY", "ORPHAN_BLOCKS"]),
]


def scenario_matrix(spark: SparkSession) -> DataFrame:
    """The locked core matrix: the product of six small, fixed dimensions, with ids."""
    out = spark.range(1, numPartitions=1)
    # explode, not crossJoin: local tables have a partition for each core, and a cartesian product multiplies them
    for name, values in (("dataset", DATASETS), ("format", FORMATS), ("corruption_type", CORRUPTIONS), ("target_class", TARGETS)):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    out = out.withColumn("m", F.explode(F.array(*(F.struct(F.lit(m).alias("magnitude"), F.lit(b).cast("long").alias("magnitude_bytes")) for m, b in MAGNITUDES))))
    out = out.select("dataset", "format", "corruption_type", "target_class", "m.magnitude", "m.magnitude_bytes").withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in SEEDS))))
    return out.select(scenario_id().alias("scenario_id"), "*")


def scenario_id() -> Column:
    return F.concat_ws("-", F.lit("p2-core"), "dataset", F.translate("format", "+", "_"), "corruption_type", "target_class", "magnitude", F.col("seed").cast("string"))


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(n) for n in needles))


def diagnostic_text() -> Column:
    return F.lower(F.concat_ws("\n", F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit(""))))


def failure_stage(code: Column, text: Column) -> Column:
    return F.when(code == 0, "NONE").when(contains_any(text, PRE_EXTRACT_MARKERS), "PRE_EXTRACT").when(contains_any(text, EXTRACTION_MARKERS), "EXTRACTION").otherwise("UNKNOWN")


def specificity(text: Column) -> Column:
    blank = F.regexp_replace(text, r"\s", "") == ""
    return F.when(blank, "NONE").when(contains_any(text, PRECISE_MARKERS), "PRECISE").when(contains_any(text, STRUCTURAL_MARKERS), "STRUCTURAL").otherwise("GENERIC")


def result_class(code: Column, claimed: Column, there: Column, stage: Column, refusal: Column) -> Column:
    return (
        F.when(code == -1, "TOOL_ERROR").when(claimed & ~there, "TOOL_ERROR").when(code == 0, "SUCCESS").when(refusal & (stage == "EXTRACTION"), "REFUSED")
        .when(refusal, "PARTIAL").when(stage == "PRE_EXTRACT", "STRUCTURAL_FAIL").when(stage == "EXTRACTION", "PARTIAL").otherwise("TOOL_ERROR")
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole within [0, 1], 0 for an empty whole."""
    return F.coalesce(F.least(F.greatest(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def blast_radius(r: Column) -> Column:
    return F.when(r >= 1.0, "NONE").when(r >= 0.9, "LOCALIZED").when(r >= 0.5, "PARTIAL_SET").when(r > 0.0, "WIDESPREAD").otherwise("TOTAL")


def completeness(has_json: Column, stderr: Column) -> Column:
    return F.when(has_json, "structured_json_result").when(F.coalesce(stderr, F.lit("")) == "", "stdout_only").otherwise("stdout_and_stderr")


def normalize(raw: DataFrame) -> DataFrame:
    """Raw runs to the flat fact table of the comparison; a missing exit code is -1."""
    code, text = F.coalesce("exit_code", F.lit(-1)), F.col("diag")
    recovered = F.least("files_recovered", "files_expected")
    out = raw.withColumn("diag", diagnostic_text()).withColumn("exit_code", code)
    out = out.withColumns({"failure_stage": failure_stage(F.col("exit_code"), text), "diagnostic_specificity": specificity(text), "refusal": contains_any(text, REFUSAL_MARKERS)})
    return out.select(
        "scenario_id", "dataset", "format", "corruption_type", "target_class", "exit_code", "failure_stage", "diagnostic_specificity",
        result_class(F.col("exit_code"), F.col("has_json_result"), F.col("has_json_file"), F.col("failure_stage"), F.col("refusal")).alias("result_class"),
        (F.col("failure_stage") == "PRE_EXTRACT").alias("detected_pre_extract"), completeness(F.col("has_json_result"), F.col("stderr")).alias("result_completeness"),
        "files_expected", recovered.alias("files_recovered"), F.least(F.col("files_missing"), F.col("files_expected") - recovered).alias("files_missing"),
        "bytes_expected", F.least("bytes_recovered", "bytes_expected").alias("bytes_recovered"),
        ratio(F.col("files_recovered"), F.col("files_expected")).alias("recovery_ratio_files"), ratio(F.col("bytes_recovered"), F.col("bytes_expected")).alias("recovery_ratio_bytes"),
        blast_radius(ratio(F.col("files_recovered"), F.col("files_expected"))).alias("blast_radius_class"), F.lit("FILE_AND_BYTE_COUNTS").alias("recovery_evidence_strength"),
        ((F.col("failure_stage") == "UNKNOWN") & (F.col("exit_code") != 0)).alias("unknown_stage_note"), (F.col("has_json_result") & ~F.col("has_json_file")).alias("missing_json_note"),
    )


def counts_by(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of each column in one pass (grouping sets): dimension, value, n."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns)))
    return runs.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def two_level_counts(runs: DataFrame, outer: str, inner: str) -> DataFrame:
    return runs.groupBy(outer, inner).agg(F.count("*").alias("n"))


def averages(runs: DataFrame, by: str) -> DataFrame:
    """Mean file and byte ratios per value, 0 where there is nothing."""
    return runs.groupBy(by).agg(F.coalesce(F.avg("recovery_ratio_files"), F.lit(0.0)).alias("mean_files"), F.coalesce(F.avg("recovery_ratio_bytes"), F.lit(0.0)).alias("mean_bytes"))


def comparison(runs: DataFrame) -> DataFrame:
    """Per format: runs, success rate, mean ratios and detection rate."""
    share = lambda c: F.avg(c.cast("double"))
    return runs.groupBy("format").agg(F.count("*").alias("total_runs"), share(F.col("recovery_ratio_files") > 0).alias("recovery_success_rate"), F.avg("recovery_ratio_files").alias("mean_recovery_ratio_files"), F.avg("recovery_ratio_bytes").alias("mean_recovery_ratio_bytes"), share(F.col("detected_pre_extract")).alias("detection_rate"))


def distribution(runs: DataFrame, by: str, column: str) -> DataFrame:
    """Share of each value of a column within each group."""
    counted = runs.groupBy(by, F.col(column).alias("label")).agg(F.count("*").alias("n"))
    total = Window.partitionBy(by)
    return counted.select(by, "label", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(total)), F.lit(0.0)).alias("share"))


def weighted_score(shares: DataFrame, by: str, weights: dict[str, float], scale: float) -> DataFrame:
    """Sum of share * weight of each label, over scale."""
    table = shares.sparkSession.createDataFrame(list(weights.items()), "label string, weight double")
    return shares.join(F.broadcast(table), "label", "left").groupBy(by).agg((F.sum(F.col("share") * F.coalesce("weight", F.lit(0.0))) / scale).alias("score"))


def ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """Positions by descending keys, ties by format name: one small row set, so one partition is right."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*(F.col(k).desc() for k in keys), "format")).cast("long"))


def rankings(runs: DataFrame) -> DataFrame:
    """The three rankings of formats: ranking, rank, format, score."""
    table = comparison(runs)
    spec = weighted_score(distribution(runs, "format", "diagnostic_specificity"), "format", SPECIFICITY_WEIGHT, 3.0).withColumnRenamed("score", "specificity")
    blast = weighted_score(distribution(runs, "format", "blast_radius_class"), "format", CONTAINMENT_WEIGHT, 1.0).withColumnRenamed("score", "containment")
    # scores are compared to 9 digits, so that equal ones tie whatever the order of their sums
    all_ = table.join(spec, "format").join(blast, "format").withColumn("composite", (F.col("detection_rate") + F.col("specificity")) / 2)
    all_ = all_.select("format", *(F.round(c, 9).alias(c) for c in ("recovery_success_rate", "mean_recovery_ratio_files", "mean_recovery_ratio_bytes", "composite", "detection_rate", "specificity", "containment")))
    parts = [
        ("survivability", "recovery_success_rate", ("recovery_success_rate", "mean_recovery_ratio_files", "mean_recovery_ratio_bytes")),
        ("diagnostic_quality", "composite", ("composite", "detection_rate", "specificity")),
        ("corruption_containment", "containment", ("containment", "mean_recovery_ratio_files")),
    ]
    return reduce(DataFrame.unionByName, (ranked(all_, *keys).select(F.lit(name).alias("ranking"), "rank", "format", F.col(score).alias("score")) for name, score, keys in parts))


def recovery_accounting(expected: DataFrame, actual: DataFrame, by: str) -> DataFrame:
    """Expected and recovered files and bytes per group; a file gives no more bytes than expected (left outer join)."""
    both = expected.join(actual.withColumnRenamed("bytes", "got"), "path", "left")
    out = both.groupBy(by).agg(F.count("*").alias("files_expected"), F.count("got").alias("files_recovered"), F.sum("bytes").alias("bytes_expected"), F.coalesce(F.sum(F.when(F.col("got").isNotNull(), F.least("got", "bytes"))), F.lit(0)).alias("bytes_recovered"))
    return out.withColumns({"files_missing": F.col("files_expected") - F.col("files_recovered"), "ratio_files": ratio(F.col("files_recovered"), F.col("files_expected")), "ratio_bytes": ratio(F.col("bytes_recovered"), F.col("bytes_expected"))})


def completeness_audit(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """finding, id: missing from the records, unexpected in them, or more than once there."""
    missing = manifest.join(records, "id", "left_anti").select(F.lit("missing").alias("finding"), "id").distinct()
    unexpected = records.join(manifest, "id", "left_anti").select(F.lit("unexpected").alias("finding"), "id").distinct()
    twice = records.groupBy("id").count().where("count > 1").select(F.lit("duplicate").alias("finding"), "id")
    return missing.unionByName(unexpected).unionByName(twice)


def execution_report(runs: DataFrame) -> DataFrame:
    """Counts by format, dataset and exit code and the json flag, with each format's first tool version by scenario."""
    counts = counts_by(runs, ["format", "dataset", "exit_code", "has_json_result"])
    first = runs.where("tool_version is not null").groupBy("format").agg(F.min_by("tool_version", "scenario_id").alias("first_version"))
    return counts.join(F.broadcast(first.select(F.lit("format").alias("dimension"), F.col("format").alias("value"), "first_version")), ["dimension", "value"], "left")


def outcome(full: Column, files: Column, blocks: Column) -> Column:
    return F.when(full > 0, OUTCOMES[3]).when(files > 0, OUTCOMES[2]).when(blocks > 0, OUTCOMES[1]).otherwise(OUTCOMES[0])


def outcome_rank(value: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, OUTCOMES)), value).cast("int") - 1, F.lit(-1))


def improvement(old: Column, new: Column) -> Column:
    step = lambda a, b, name: ((old == OUTCOMES[a]) & (new == OUTCOMES[b]), name)
    steps = [step(1, 2, "IMPROVED_ORPHAN_TO_PARTIAL"), step(1, 3, "IMPROVED_ORPHAN_TO_FULL"), step(0, 2, "IMPROVED_NONE_TO_PARTIAL"), step(0, 3, "IMPROVED_NONE_TO_FULL")]
    out = F.when(*steps[0])
    for s in steps[1:]:
        out = out.when(*s)
    return out.when(outcome_rank(new) > outcome_rank(old), "IMPROVED_OTHER").when(outcome_rank(new) < outcome_rank(old), "DEGRADED").otherwise("UNCHANGED")


METRICS = ["verified_block_count", "salvageable_file_count", "exported_full_file_count"]


def pair_variants(results: DataFrame) -> DataFrame:
    """Old and new results of each scenario that has both, side by side, with outcomes and the kind of change."""
    side = lambda v: results.where(F.col("variant") == v).select("scenario_id", "dataset", "corruption_target", *(F.col(m).alias(f"{v}_{m}") for m in METRICS))
    out = side("old").join(side("new").drop("dataset", "corruption_target"), "scenario_id")
    for v in ("old", "new"):
        out = out.withColumn(f"{v}_outcome", outcome(F.col(f"{v}_{METRICS[2]}"), F.col(f"{v}_{METRICS[1]}"), F.col(f"{v}_{METRICS[0]}")))
    return out.withColumn("change", improvement(F.col("old_outcome"), F.col("new_outcome")))


def delta_groups(pairs: DataFrame, by: str) -> DataFrame:
    """Scenarios and signed deltas of the metrics per group."""
    return pairs.groupBy(by).agg(F.count("*").alias("scenarios"), *(F.sum(F.col(f"new_{m}") - F.col(f"old_{m}")).cast("long").alias(f"delta_{m}") for m in METRICS))


def outcome_pivot(pairs: DataFrame, by: str, column: str) -> DataFrame:
    """Counts of the fixed outcomes per group, 0 where none."""
    return pairs.groupBy(by).agg(*(F.count_if(F.col(column) == o).alias(o.lower()) for o in OUTCOMES))


def improvement_counters(pairs: DataFrame) -> DataFrame:
    old, new = outcome_rank(F.col("old_outcome")), outcome_rank(F.col("new_outcome"))
    return pairs.agg(F.count_if((old <= 1) & (new >= 2)).alias("raised"), F.count_if(new > old).alias("improved"), F.count_if(new < old).alias("degraded"), F.count_if(new == old).alias("unchanged"))


def outcome_rollup(runs: DataFrame) -> DataFrame:
    """Per outcome, zero-filled over the fixed list: runs, their ids in order, and sums."""
    fixed = runs.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    own = runs.withColumn("outcome", outcome(F.col("exported_full_file_count"), F.col("salvageable_file_count"), F.col("verified_block_count")))
    sums = ["verified_block_count", "salvageable_file_count", "unsalvageable_file_count", "exported_block_count", "exported_extent_count"]
    found = own.groupBy("outcome").agg(F.count("*").alias("runs"), F.min("archive_id").alias("first_id"), F.max("archive_id").alias("last_id"), *(F.sum(c).alias(c) for c in sums))
    return fixed.join(found, "outcome", "left").select("outcome", F.coalesce("runs", F.lit(0)).alias("runs"), "first_id", "last_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums))


def profile_key(path: Column) -> Column:
    """The key after the first marker, upper case, else UNKNOWN_PROFILE."""
    name = F.lower(F.substring_index(F.translate(path, "\\", "/"), "/", -1))
    keys = [F.regexp_extract(name, marker + r"([^._\-]+)", 1) for marker in ("_profile_", "-profile-", "_damage_", "-damage-")]
    return F.upper(F.coalesce(*(F.when(k != "", k) for k in keys), F.lit("unknown_profile")))


def class_rank(counts: dict[str, Column]) -> Column:
    """Best recovery class that occurs, by either spelling; counts: a column for each class name."""
    out = None
    for label, names in CLASS_RANKS:
        n = reduce(lambda a, b: a + b, (counts.get(x, F.lit(0)) for x in names))
        out = F.when(n > 0, label) if out is None else out.when(n > 0, label)
    return out.otherwise("none")


def class_histogram(rows: DataFrame, by: str) -> DataFrame:
    """Per group: rows, the count of each class name and the best rank."""
    names = [n for _, ns in CLASS_RANKS for n in ns]
    out = rows.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col("class") == x).alias(x) for x in names))
    return out.withColumn("best", class_rank({x: F.col(x) for x in names}))


def fail_closed(variant: Column, rank: Column, copies: Column, conflict: Column) -> Column:
    """Dictionary layouts with a conflict or without a copy recover names no more: named falls to anonymous."""
    broken = variant.startswith("extent_identity_path_dict_") & (conflict | (copies == 0))
    return F.when(broken & (rank == "named"), "anonymous").otherwise(rank)


def path_bucket(n: Column) -> Column:
    return F.when(n >= 180, "very_long").when(n >= 120, "long").otherwise("normal")


def density_bucket(n: Column, low: str = "low_fragmentation") -> Column:
    return F.when(n >= 32, "extreme_fragmentation").when(n >= 8, "fragmented").otherwise(low)


def logical_key(path: Column) -> Column:
    """The path without the fragment suffix of its file name."""
    return F.regexp_replace(path, r"(__frag_|_fragment_)[^/]*$", "")


def variant_rollup(rows: DataFrame, base: str) -> DataFrame:
    """Sums per variant with the difference of bytes to the base variant and the gain per KiB of it."""
    out = rows.groupBy("variant").agg(F.count("*").alias("scenarios"), F.sum("archive_bytes").alias("bytes"), F.count_if(F.col("class").isin("FULL_VERIFIED", "FULL_NAMED_VERIFIED")).alias("named"))
    all_ = Window.partitionBy(F.lit(1))
    base_of = lambda c: F.max(F.when(F.col("variant") == base, F.col(c))).over(all_)
    out = out.withColumns({"delta_bytes": F.col("bytes") - base_of("bytes"), "delta_named": F.col("named") - base_of("named")})
    return out.withColumn("named_per_kib", F.when(F.col("delta_bytes") > 0, F.col("delta_named") / (F.col("delta_bytes") / 1024.0)).otherwise(0.0))


def breakdowns(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, key, variant, n, named: all breakdowns in one pass instead of a filter for each key."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.cast("string").alias("key")) for k, v in fields.items())))
    return rows.select(pairs.alias("p"), "variant", "class").groupBy("p.field", "p.key", "variant").agg(F.count("*").alias("n"), F.count_if(F.col("class").isin("FULL_VERIFIED", "FULL_NAMED_VERIFIED")).alias("named"))


def baseline_gain(rows: DataFrame, keys: list[str], regime: str, base: str, value: str) -> DataFrame:
    """Each row's value against that of the base regime of its keys: baseline, unchanged, base->value or unknown."""
    own = F.max(F.when(F.col(regime) == base, F.col(value))).over(Window.partitionBy(*keys))
    gain = F.when(F.col(regime) == base, "baseline").when(own.isNull(), "unknown").when(own == F.col(value), "unchanged").otherwise(F.concat(own, F.lit("->"), F.col(value)))
    return rows.withColumn("gain", gain)


def side_by_side(rows: DataFrame, key: str, variants: list[str], value: str) -> DataFrame:
    """One row per key with a column for each of a fixed list of variants."""
    return rows.groupBy(key).pivot("variant", variants).agg(F.max(value))


def stress_stats(extents: DataFrame, key: str) -> DataFrame:
    """Histogram of extents per logical file: an aggregate of an aggregate."""
    return extents.groupBy(key).agg(F.count("*").alias("extents")).groupBy("extents").agg(F.count("*").alias("files")).orderBy("extents")
