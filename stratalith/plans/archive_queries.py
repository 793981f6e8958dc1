"""Archives made of the parts table, written and read back, and their damage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import duck
from ..operators import damage, lab
from ..sources import archive as ar
from .registry import query

# Entries: parts by size, with directories and empty files among them; every part of a multiple of 13 is damaged later.
_ENTRIES = """SELECT CAST(p_size AS STRING) AS archive, p_type || '/' || CAST(p_partkey AS STRING) AS entry_path, CASE WHEN p_partkey % 10 = 0 THEN 'directory' ELSE 'regular' END AS kind,
    CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 17 <> 0 THEN p_name || '-' || p_brand END AS body, p_partkey AS id FROM {part}"""
_E = _ENTRIES.format(part="part")


def entries(spark, d):
    return spark.sql(_ENTRIES, part=spark.read.parquet(f"{d}/part.parquet"))


def _records(spark, d):
    """A manifest record of every regular file with content."""
    e = entries(spark, d).where("body is not null")
    return e.select("archive", F.to_json(F.struct(F.col("entry_path").alias("path"), F.lit("file-manifest").alias("schema"), F.octet_length("body").alias("size"))).alias("json"))


def archives(spark, d, records=False):
    files = entries(spark, d).select("archive", "entry_path", "kind", F.col("body").cast("binary").alias("data"))
    return ar.pack(files, records=_records(spark, d) if records else None, dictionaries={5: b"words", 7: b"more words"}, ledger=True)


@query("s4_entries", f"SELECT archive, entry_path, kind, CAST(ROW_NUMBER() OVER (PARTITION BY archive ORDER BY entry_path) - 1 AS BIGINT) AS ordinal, COALESCE(strlen(body), 0) AS size, CASE WHEN body IS NULL THEN 0 ELSE 1 END AS extents FROM ({_E})")
def s4(spark, d):
    """The index that the writer put into every archive (K1, K2), decoded."""
    return ar.parse(archives(spark, d), "entries").select("archive", "entry_path", "kind", "ordinal", "size", F.size("extents").alias("extents"))


@query("s2_blocks", f"SELECT archive, CAST(ROW_NUMBER() OVER (PARTITION BY archive ORDER BY entry_path) - 1 AS BIGINT) AS block_id, strlen(body) AS raw_len, true AS payload_ok FROM ({_E}) WHERE body IS NOT NULL")
def s2(spark, d):
    """A sequential scan of the block region, with headers (S5) and payload digests."""
    return ar.parse(archives(spark, d), "blocks").select("archive", "block_id", "raw_len", "payload_ok")


@query("s3_candidates", f"SELECT archive, COUNT(body) AS candidates, COUNT(body) AS verified FROM ({_E}) GROUP BY archive HAVING COUNT(body) > 0")
def s3(spark, d):
    """A scan for blocks at any offset, that needs no index."""
    return ar.parse(archives(spark, d), "candidates").groupBy("archive").agg(F.count("*").alias("candidates"), F.count_if("verified").alias("verified"))


@query("s1_tail", f"SELECT DISTINCT archive, CAST(1 AS BIGINT) AS version, true AS has_dictionaries, true AS has_index, true AS in_order FROM ({_E})")
def s1(spark, d):
    """Footer (S6) and tail frame (S7): parts are there and in order."""
    t = ar.parse(archives(spark, d), "footer")
    order = (F.col("dct_offset") >= F.col("blocks_end")) & (F.col("index_offset") == F.col("dct_offset") + F.col("dct_len")) & (F.col("ledger_offset") == F.col("index_offset") + F.col("index_len"))
    return t.select("archive", "version", (F.col("dct_len") > 0).alias("has_dictionaries"), (F.col("index_len") > 0).alias("has_index"), order.alias("in_order"))


@query("s8_dictionaries", f"SELECT archive, dict_id, length FROM (SELECT DISTINCT archive FROM ({_E})), (VALUES (CAST(5 AS BIGINT), CAST(5 AS BIGINT)), (7, 10)) t(dict_id, length)")
def s8(spark, d):
    return ar.parse(archives(spark, d), "dictionaries").select("archive", "dict_id", "length")


@query("s9_ledgers", f"""SELECT archive, '{{"files":[' || COALESCE(string_agg('{{"path":"' || entry_path || '","size":' || COALESCE(strlen(body), 0) || '}}', ',' ORDER BY entry_path) FILTER (kind = 'regular'), '') || ']}}' AS json FROM ({_E}) GROUP BY archive""")
def s9(spark, d):
    """The ledger, in canonical JSON (K4)."""
    return ar.parse(archives(spark, d), "ledger").select("archive", "json")


@query("s14_discovery", f"SELECT archive, true AS found FROM ({_E}) GROUP BY archive UNION ALL SELECT CAST(id AS VARCHAR), false FROM ({_E}) WHERE body IS NOT NULL")
def s14(spark, d):
    """Archives are told from other contents by their signatures."""
    other = entries(spark, d).where("body is not null").select(F.col("id").cast("string").alias("archive"), F.col("body").cast("binary").alias("content"))
    return archives(spark, d).unionByName(other).select("archive", ar.is_archive(F.col("content")).alias("found"))


@query("s10_metadata_records", f"SELECT archive, 'file-manifest' AS schema, entry_path AS path, strlen(body) AS size FROM ({_E}) WHERE body IS NOT NULL")
def s10(spark, d):
    """JSON records of verified metadata blocks, told apart by their schema (H20 writes them)."""
    r = ar.parse(archives(spark, d, True), "records").withColumn("r", F.from_json("json", "path string, schema string, size long"))
    return r.where("r.schema is not null").select("archive", "r.schema", "r.path", "r.size")


@query("h9_metadata_stats", f"SELECT archive, 'file-manifest' AS schema, COUNT(*) AS records, CAST(SUM(strlen('{{\"path\":\"' || entry_path || '\",\"schema\":\"file-manifest\",\"size\":' || strlen(body) || '}}')) AS BIGINT) AS bytes FROM ({_E}) WHERE body IS NOT NULL GROUP BY archive")
def h9(spark, d):
    r = ar.parse(archives(spark, d, True), "records")
    return r.groupBy("archive", F.from_json("json", "schema string")["schema"].alias("schema")).agg(F.count("*").alias("records"), F.sum("raw_len").alias("bytes"))


@query("k7_extracted", f"SELECT archive, entry_path, COALESCE(strlen(body), 0) AS size, sha256(COALESCE(body, '')) AS sha256, 'safe' AS verdict FROM ({_E}) WHERE kind = 'regular'")
def k7(spark, d):
    """Strict extraction (F29, F30): every file decoded and assembled."""
    return ar.extracted(archives(spark, d))


@query("h6_verified_blocks", f"SELECT archive, CAST(ROW_NUMBER() OVER (PARTITION BY archive ORDER BY entry_path) - 1 AS BIGINT) AS block_id, strlen(body) AS raw_len, sha256(body) AS sha256 FROM ({_E}) WHERE body IS NOT NULL")
def h6(spark, d):
    """Blocks that verify, decoded for export."""
    return ar.parse(archives(spark, d), "verified")


@query("s17_ranges", f"SELECT archive, entry_path, CAST(3 AS BIGINT) AS offset_, substr(body, 4, 6) AS body FROM ({_E}) WHERE body IS NOT NULL")
def s17(spark, d):
    """Random access: bytes 3 to 8 of every file, from the blocks that hold them."""
    wanted = entries(spark, d).where("body is not null").select("archive", "entry_path", F.lit(3).cast("long").alias("offset"), F.lit(6).cast("long").alias("length"))
    return ar.ranges_of(archives(spark, d), wanted).select("archive", "entry_path", F.col("offset").alias("offset_"), F.col("body").cast("string").alias("body"))


@query("v4_strict_extraction", f"""SELECT archive, entry_path, CASE WHEN first THEN 'refused' ELSE 'safe' END AS verdict FROM (SELECT *, body IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY archive, body IS NULL ORDER BY entry_path) = 1 AND CAST(archive AS INT) % 2 = 0 AS first FROM ({_E})) WHERE kind = 'regular'""")
def v4(spark, d):
    """In every second archive the first block's payload is hit; its file is refused, all others stay safe."""
    from pyspark.sql.functions import concat, length, substring

    c, at = F.col("content"), ar.FIXED + 96 + 1 + 3
    # the first payload begins after a header with both digests; its fourth byte is overwritten
    hit = concat(substring(c, 1, at - 1), F.lit(b"\x00\x01\x02"), substring(c, at + 3, length(c)))
    return ar.extracted(archives(spark, d).withColumn("content", F.when(F.col("archive").cast("int") % 2 == 0, hit).otherwise(c))).select("archive", "entry_path", "verdict")


_CASES = """SELECT p_partkey AS id, p_name || p_brand || p_type AS body, c.corruption_type, CASE p_partkey % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'index' WHEN 2 THEN 'payload' ELSE 'tail' END AS target,
    CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 256 ELSE 4 END AS magnitude_bytes, CASE p_size % 3 WHEN 0 THEN 1337 WHEN 1 THEN 2600 ELSE 65535 END AS seed
    FROM {part} CROSS JOIN (SELECT 'bit_flip' AS corruption_type UNION ALL SELECT 'byte_overwrite' UNION ALL SELECT 'zero_fill' UNION ALL SELECT 'truncation' UNION ALL SELECT 'tail_damage') c"""
_PLACED = f"""SELECT *, CASE WHEN e > b THEN CASE corruption_type WHEN 'truncation' THEN n - least(magnitude_bytes, greatest(n - (b + seed % (e - b)), 0)) WHEN 'tail_damage' THEN e - least(magnitude_bytes, e - b) ELSE CASE WHEN magnitude_bytes >= e - b THEN b ELSE b + seed % (e - b - magnitude_bytes + 1) END END END AS range_start,
    CASE WHEN e > b THEN CASE corruption_type WHEN 'truncation' THEN n WHEN 'tail_damage' THEN e ELSE CASE WHEN magnitude_bytes >= e - b THEN e ELSE b + seed % (e - b - magnitude_bytes + 1) + magnitude_bytes END END END AS range_end
    FROM (SELECT *, CASE target WHEN 'header' THEN 0 WHEN 'index' THEN least(h, n) WHEN 'payload' THEN i ELSE p END AS b, CASE target WHEN 'header' THEN least(h, n) WHEN 'index' THEN i WHEN 'payload' THEN p ELSE n END AS e
    FROM (SELECT *, least(greatest(n * 7 // 8, i + 1), n) AS p FROM (SELECT *, least(greatest(n // 2, h + 1), n) AS i FROM (SELECT *, strlen(body) AS n, greatest(strlen(body) // 8, 1) AS h FROM ({_CASES.format(part="part")})))))"""
_MIXED = "(CAST(seed AS HUGEINT) * 2654435769 + CAST(x AS HUGEINT) * 2246822507 + CAST(x - range_start AS HUGEINT) * 3266489909)"
_MASK = f"CAST(xor(xor({_MIXED}, {_MIXED} >> 16), {_MIXED} >> 32) & 255 AS INT)"
_BYTE = f"""CASE WHEN range_start IS NULL OR x < range_start OR x >= range_end THEN v WHEN corruption_type = 'bit_flip' THEN xor(v, 1 << CAST((seed + x - range_start) % 8 AS INT)) WHEN corruption_type = 'byte_overwrite' THEN {_MASK} WHEN corruption_type = 'zero_fill' THEN 0 ELSE xor(xor(v, {_MASK}), 165) END"""


@query("l1_mutations", f"SELECT id, corruption_type, CAST(range_start AS BIGINT) AS range_start, CAST(range_end AS BIGINT) AS range_end, CAST(CASE WHEN corruption_type = 'truncation' THEN COALESCE(range_start, n) ELSE n END AS BIGINT) AS new_size FROM ({_PLACED})")
def l1(spark, d):
    """Where each locked mutation lies, from lengths alone."""
    cases = spark.sql(_CASES, part=spark.read.parquet(f"{d}/part.parquet")).withColumn("size", F.octet_length("body").cast("long"))
    return damage.mutations(cases).select("id", "corruption_type", "range_start", "range_end", "new_size")


@query("h17_mutation_log", f"SELECT CAST(c.id AS VARCHAR) || '/' || c.corruption_type AS key, sha256(c.body) AS before, COALESCE(t.hexed, '') AS after_hex FROM ({_CASES.format(part='part')}) c LEFT JOIN (SELECT id, corruption_type, string_agg(printf('%02X', b), '' ORDER BY x) AS hexed FROM (SELECT id, corruption_type, x, {_BYTE} AS b FROM (SELECT *, ord(substr(body, CAST(x AS INT) + 1, 1)) AS v FROM (SELECT *, unnest(range(CASE WHEN corruption_type = 'truncation' THEN COALESCE(range_start, n) ELSE n END)) AS x FROM ({_PLACED})))) GROUP BY id, corruption_type) t ON c.id = t.id AND c.corruption_type = t.corruption_type")
def h17(spark, d):
    """The bytes after every mutation, with the digest before it (L1, H16)."""
    cases = spark.sql(_CASES, part=spark.read.parquet(f"{d}/part.parquet"))
    cases = cases.select(F.concat_ws("/", F.col("id").cast("string"), "corruption_type").alias("name"), "corruption_type", "target", "magnitude_bytes", "seed", F.col("body").cast("binary").alias("content"))
    return damage.corrupt(cases, "name").select("key", "before", F.hex("content").alias("after_hex"))
