"""Catalogue, preservation profiles, path rules and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Suffixes of formats that do not compress further, and of structured text, text and code.
INCOMPRESSIBLE = [".png", ".jpg", ".jpeg", ".webp", ".gif", ".mp4", ".mkv", ".mov", ".mp3", ".ogg", ".opus", ".flac", ".pdf", ".zip", ".rar", ".gz", ".xz", ".bz2", ".zst", ".dwarfs", ".dwarfsx", ".ktc", ".squashfs"]
TEXT = [".json", ".yaml", ".yml", ".toml", ".xml", ".txt", ".md", ".rst", ".log"]
CODE = [".rs", ".c", ".cc", ".cpp", ".h", ".hpp", ".py", ".sh", ".bash", ".zsh", ".js", ".ts", ".css", ".html"]
# The numeric identifier of strict semantic versions and the whole pattern.
_NUMBER = r"(0|[1-9][0-9]*)"
SEMVER = rf"^{_NUMBER}\.{_NUMBER}\.{_NUMBER}(-({_NUMBER}|[0-9]*[A-Za-z\-][0-9A-Za-z\-]*)(\.({_NUMBER}|[0-9]*[A-Za-z\-][0-9A-Za-z\-]*))*)?(\+[0-9A-Za-z\-]+(\.[0-9A-Za-z\-]+)*)?$"

SPECIAL = ["fifo", "char_device", "block_device"]


def omission_reason(profile: Column, kind: Column) -> Column:
    """Why a profile leaves an entry out, or null."""
    return F.when((profile == "basic") & kind.isin(SPECIAL), "basic_omits_special_entries").when((profile == "payload_only") & (kind == "symlink"), "payload_only_omits_symlinks").when((profile == "payload_only") & kind.isin(SPECIAL), "payload_only_omits_special_entries")


def profile_plan(files: DataFrame, profile: str) -> DataFrame:
    """Entries with the columns a profile keeps; what it leaves out has a reason and no metadata."""
    name = F.lit(profile)
    out = files.withColumn("omission_reason", omission_reason(name, F.col("kind")))
    if profile in ("basic", "payload_only"):
        out = out.withColumns({"uid": F.lit(0).cast("long"), "gid": F.lit(0).cast("long"), "uname": F.lit(None).cast("string"), "n_xattrs": F.lit(0).cast("long")})
    if profile == "payload_only":
        regular = F.col("kind") == "regular"
        plain = F.col("kind").isin("regular", "directory")
        out = out.withColumns({"mode": F.when(plain, 0).otherwise(F.col("mode")).cast("long"), "mtime": F.when(plain, -1).otherwise(F.col("mtime")).cast("long"), "hardlink_key": F.when(~regular, F.col("hardlink_key")), "sparse": F.col("sparse") & ~regular, "device_major": F.lit(None).cast("long")})
    return out


def capture_requirements(spark) -> DataFrame:
    """What each profile captures."""
    return spark.createDataFrame([("full", True, True, True), ("basic", False, False, True), ("payload_only", False, False, False)], "profile string, ownership_names boolean, xattrs boolean, sparse_layout boolean")


def _ends(path: Column, suffixes: list[str]) -> Column:
    return F.lower(path).rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$")


def content_group(path: Column) -> Column:
    """3 incompressible, 0 text, 1 code, else 2."""
    return F.when(_ends(path, INCOMPRESSIBLE), 3).when(_ends(path, TEXT), 0).when(_ends(path, CODE), 1).otherwise(2)


def confined_path(path: Column) -> tuple[Column, Column]:
    """The normal form of an archive path and why it is rejected (null: it is not)."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    reason = F.when(path == "", "empty").when(path.startswith("/"), "absolute").when(F.array_contains(parts, ".."), "parent_traversal").when(F.size(parts) == 0, "empty_normalized")
    return F.when(reason.isNull(), F.array_join(parts, "/")), reason


def symlink_allowed(target: Column) -> Column:
    """Only non-empty relative targets without parent steps."""
    parts = F.split(target, "/")
    return (target != "") & ~target.startswith("/") & ~F.array_contains(parts, "..")


def safe_component(name: Column) -> Column:
    """Letters, digits, dot, dash and underscore; anything else becomes an underscore."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._\-]", "_")


def valid_semver(value: Column) -> Column:
    return value.rlike(SEMVER)


def duplicate_paths(files: DataFrame) -> DataFrame:
    """Paths that stand more than once other than as directories, with their sources in order."""
    out = files.groupBy("path").agg(F.count("*").alias("n"), F.bool_and(F.col("kind") == "directory").alias("directories"), F.sort_array(F.collect_list("source")).alias("sources"))
    return out.where("n > 1 AND NOT directories").select("path", "n", F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that are not unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def index_summary(files: DataFrame, extents: DataFrame) -> DataFrame:
    """One row of counts by kind, flags and sums."""
    kinds = ("regular", "directory", "symlink", "fifo", "char_device", "block_device")
    return files.agg(F.count("*").alias("entries"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.bool_or("sparse").alias("has_sparse"), F.bool_or(F.col("hardlink_key").isNotNull()).alias("has_hardlinks"), F.bool_or(F.col("n_xattrs") > 0).alias("has_xattrs"), F.sum("size").alias("bytes")).crossJoin(extents.agg(F.count("*").alias("extents")))


def distinct_or_mixed(df: DataFrame, column: str) -> DataFrame:
    """The single value of a column, or ``mixed (a, b)``, or ``none``."""
    values = F.array_sort(F.collect_set(F.col(column).cast("string")))
    return df.agg(values.alias("v")).select(F.when(F.size("v") == 0, "none").when(F.size("v") == 1, F.element_at("v", 1)).otherwise(F.concat(F.lit("mixed ("), F.array_join("v", ", "), F.lit(")"))).alias(column))


def listing(files: DataFrame) -> DataFrame:
    """Every directory prefix once, and every file."""
    parts = F.split("path", "/")
    prefixes = files.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
    return prefixes.select("path", F.lit("prefix").alias("entry")).unionByName(files.select("path", F.lit("file").alias("entry")))


def metadata_state(kept: Column, there: Column) -> Column:
    return F.when(~kept, "omitted_by_profile").when(there, "present").otherwise("not_present")


def archive_state(extents: DataFrame) -> DataFrame:
    """Whether every file has exactly one extent."""
    return extents.groupBy("file_id").agg(F.count("*").alias("n")).agg(F.when(F.max("n") == 1, "one_extent_per_file").otherwise("fragmented").alias("state"), F.max("n").alias("most"))


def hardlink_sources(files: DataFrame) -> DataFrame:
    """The first path of each hard-link key is the source; the others refer to it."""
    keyed = files.where("hardlink_key IS NOT NULL")
    source = keyed.groupBy("hardlink_key").agg(F.min("path").alias("source"))
    return keyed.join(source, "hardlink_key").select("path", "hardlink_key", "source", (F.col("path") == F.col("source")).alias("is_source"))


def inventory_digest(rows: DataFrame) -> DataFrame:
    """Digest of the ordered lines path:bytes, per dataset."""
    lines = F.sort_array(F.collect_list(F.struct("path", F.concat(F.col("path").cast("string"), F.lit(":"), F.col("bytes").cast("string"), F.lit("\n")).alias("line"))))
    return rows.groupBy("dataset").agg(lines.alias("x")).select("dataset", F.sha2(F.array_join("x.line", "").cast("binary"), 256).alias("digest"))
