"""Views that map the driver tables onto the data model, in SQL that Spark and DuckDB both read.

``frame`` gives a view as a DataFrame; ``duck`` puts the same text in front of an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    # blocks of an archive; every eleventh is damaged
    "blocks": """SELECT p_partkey AS block_id, p_size AS level, CASE p_size % 3 WHEN 0 THEN 'zstd' WHEN 1 THEN 'lz4' ELSE 'store' END AS codec,
        p_partkey * 4096 AS scan_offset, p_size * 1000 + p_partkey % 97 AS comp_len, p_size * 1500 + p_partkey % 89 AS raw_len,
        p_partkey % 11 = 0 AS corrupt, p_name AS payload FROM {part}""",
    "corrupt_blocks": "SELECT p_partkey AS block_id FROM {part} WHERE p_partkey % 11 = 0",
    "files": """SELECT o_orderkey AS file_id, o_orderpriority || '/' || CAST(o_orderkey AS STRING) AS path,
        CASE o_orderkey % 20 WHEN 0 THEN 'directory' WHEN 1 THEN 'symlink' WHEN 2 THEN 'fifo' WHEN 3 THEN 'char_device' WHEN 4 THEN 'block_device' ELSE 'regular' END AS kind,
        o_orderkey % 5000 AS size, CAST(420 + o_orderkey % 3 AS BIGINT) AS mode, o_orderkey * 1000 AS mtime, o_custkey % 7 AS uid, o_custkey % 5 AS gid,
        CASE WHEN o_orderkey % 4 = 0 THEN 'user' || CAST(o_custkey % 7 AS STRING) END AS uname, o_custkey % 3 AS n_xattrs,
        o_orderkey % 9 = 0 AS sparse, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey END AS hardlink_key, CASE WHEN o_orderkey % 20 IN (3, 4) THEN o_custkey % 11 END AS device_major
        FROM {orders}""",
    # extents of files; every seventh file has a gap after its first extent
    "extents": """SELECT l_orderkey AS file_id, l_partkey AS block_id, CAST(l_quantity AS BIGINT) AS len, CAST(l_linenumber AS BIGINT) AS line,
        CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS BIGINT) AS ordinal,
        COALESCE(CAST(SUM(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0)
            + CASE WHEN l_orderkey % 7 = 0 AND ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) > 1 THEN 3 ELSE 0 END AS logical_offset
        FROM {lineitem}""",
    "raw_runs": """SELECT event_id AS scenario_id, event_type AS format, CASE event_id % 3 WHEN 0 THEN 'smallfiles' WHEN 1 THEN 'mixed' ELSE 'largefiles' END AS dataset,
        CASE event_id % 5 WHEN 0 THEN 'bit_flip' WHEN 1 THEN 'byte_overwrite' WHEN 2 THEN 'zero_fill' WHEN 3 THEN 'truncation' ELSE 'tail_damage' END AS corruption_type,
        CASE event_id % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'index' WHEN 2 THEN 'payload' ELSE 'tail' END AS target_class,
        CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS exit_code,
        event_id % 2 = 0 AS has_json_result, event_id % 22 <> 0 AS has_json_file,
        CASE user_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'Bad MAGIC in block' WHEN 2 THEN 'hash mismatch at FTR4' WHEN 3 THEN 'CRC error in payload/a.bin' WHEN 4 THEN 'operation refused'
            WHEN 5 THEN 'skipping to next header' WHEN 6 THEN 'length error, expected 9' WHEN 7 THEN 'checksum wrong' WHEN 8 THEN 'no clue' WHEN 9 THEN 'unexpected end of file'
            WHEN 10 THEN 'cannot inflate' ELSE '  ' END AS stdout,
        CASE WHEN user_id % 5 = 0 THEN 'archive index damaged' WHEN user_id % 5 = 1 THEN 'file #3 lost' ELSE '' END AS stderr,
        event_id % 9 AS files_expected, user_id % 11 AS files_recovered, user_id % 4 AS files_missing, (event_id % 9) * 100 AS bytes_expected, user_id % 1000 AS bytes_recovered,
        CASE WHEN event_id % 6 <> 0 THEN '1.' || CAST(user_id % 3 AS STRING) || '.0' END AS tool_version FROM {events}""",
    "expected": "SELECT doc_id AS path, n_chars AS bytes, source AS dataset FROM {documents}",
    "actual": "SELECT doc_id AS path, CAST(doc_id % 3000 AS BIGINT) AS bytes FROM {labels}",
    # results of one scenario under an old and a new layout
    "ab": """SELECT l_orderkey AS scenario_id, MIN(CASE l_orderkey % 3 WHEN 0 THEN 'smallfiles' WHEN 1 THEN 'mixed' ELSE 'largefiles' END) AS dataset,
        MIN(CASE l_orderkey % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'index' WHEN 2 THEN 'payload' ELSE 'tail' END) AS corruption_target,
        CASE l_returnflag WHEN 'A' THEN 'old' ELSE 'new' END AS variant, COUNT(*) AS verified_block_count,
        SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS salvageable_file_count, SUM(CASE WHEN l_quantity > 42 THEN 1 ELSE 0 END) AS exported_full_file_count
        FROM {lineitem} WHERE l_returnflag IN ('A', 'N') GROUP BY l_orderkey, l_returnflag""",
    "experiments": """SELECT c_custkey AS archive_id, 'runs/set_profile_' || lower(c_mktsegment) || '.arc' AS archive_path, c_nationkey AS verified_block_count,
        c_custkey % 4 AS salvageable_file_count, c_custkey % 5 AS unsalvageable_file_count, c_custkey % 3 AS unmappable_file_count, c_custkey % 6 AS exported_block_count,
        c_custkey % 7 AS exported_extent_count, CASE WHEN c_custkey % 9 = 0 THEN 2 ELSE 0 END AS exported_full_file_count FROM {customer}""",
    "variants": """SELECT o_orderkey AS scenario_id, CASE o_orderkey % 4 WHEN 0 THEN 'payload_only' WHEN 1 THEN 'full' WHEN 2 THEN 'manifest' ELSE 'path_dict' END AS variant,
        CASE o_custkey % 3 WHEN 0 THEN 'smallfiles' WHEN 1 THEN 'mixed' ELSE 'largefiles' END AS dataset,
        CASE o_custkey % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'index' WHEN 2 THEN 'payload' ELSE 'tail' END AS target,
        CASE o_custkey % 6 WHEN 0 THEN 'FULL_VERIFIED' WHEN 1 THEN 'FULL_ANONYMOUS' WHEN 2 THEN 'PARTIAL_ORDERED' WHEN 3 THEN 'PARTIAL_UNORDERED' WHEN 4 THEN 'ORPHAN_BLOCKS' ELSE 'FULL_NAMED_VERIFIED' END AS class,
        o_orderkey % 700 + 100 AS archive_bytes, o_custkey % 230 AS path_length, o_custkey % 40 AS extents_per_file, o_orderkey % 3 AS manifests, o_orderkey % 5 AS paths FROM {orders}""",
    "tree": """SELECT p_name || CASE p_size % 9 WHEN 0 THEN '.JSON' WHEN 1 THEN '.png' WHEN 2 THEN '.rs' WHEN 3 THEN '.txt' WHEN 4 THEN '.tar.gz' WHEN 5 THEN '.yaml' WHEN 6 THEN '.html' WHEN 7 THEN '' ELSE '.Dat' END AS path,
        p_partkey * 37 % 10007 AS size, CASE p_partkey % 10 WHEN 0 THEN 'directory' WHEN 1 THEN 'symlink' ELSE 'file' END AS kind, p_type AS sample, p_partkey AS id FROM {part}""",
    "bench_runs": """SELECT CASE l_suppkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS dataset, CAST(l_linenumber AS BIGINT) AS zstd_level, CASE l_returnflag WHEN 'R' THEN 'tar_xz' ELSE 'tar_zstd' END AS tool,
        l_partkey * 13 % 9973 AS archive_size_bytes, l_orderkey % 887 AS pack_time_ms, l_suppkey % 71 AS extract_time_ms FROM {lineitem}""",
    "identity": """SELECT l_orderkey AS file_id, l_partkey AS block_id, CAST(l_linenumber AS BIGINT) - 1 AS block_index, CAST(l_orderkey % 5 + 2 AS BIGINT) AS total_blocks, l_suppkey AS path_id,
        CAST(l_quantity AS BIGINT) AS logical_length, l_partkey * 4096 AS block_scan_offset FROM {lineitem}""",
    "paths": "SELECT s_suppkey AS path_id, s_name AS path, s_nationkey AS dir_id, s_suppkey % 8 <> 0 AS digest_ok, s_suppkey % 2 AS generation FROM {supplier}",
    "directories": "SELECT n_nationkey AS dir_id, n_name AS dir_name, n_regionkey AS root_id FROM {nation}",
    # identity records of the payload blocks of small archives (orders) with up to two files; some archives break a rule
    "claims": """SELECT archive, file_id, block_index AS seq, block_index + CASE WHEN archive % 13 = 0 AND block_index > 0 THEN 1 ELSE 0 END AS block_index, total + CASE WHEN archive % 5 = 0 THEN 1 ELSE 0 END AS total_block_count,
        size AS full_file_size, before AS logical_offset, len AS logical_length, CASE WHEN archive % 41 = 0 THEN 2 ELSE 1 END AS payload_codec, len AS payload_length, block_id,
        CASE WHEN block_id % 2 = 0 THEN block_id * 4096 END AS block_scan_offset, CASE WHEN archive % 43 = 0 THEN 'a' || CAST(block_index AS STRING) ELSE 'a' || CAST(archive AS STRING) END AS archive_identity,
        'p' || CAST(block_id AS STRING) AS payload_hash, 'h' || CAST(block_id AS STRING) AS raw_hash, CASE WHEN archive % 3 = 0 THEN file_id END AS path_id,
        CASE WHEN archive % 3 = 1 THEN 'f' || CAST(file_id AS STRING) || '.txt' END AS name, CASE WHEN archive % 3 = 1 THEN 'own/f' || CAST(file_id AS STRING) || '.txt' END AS path,
        CASE WHEN archive % 3 <> 1 THEN NULL WHEN archive % 7 = 0 THEN 'bad' ELSE md5('own/f' || CAST(file_id AS STRING) || '.txt') END AS path_digest
        FROM (SELECT l_orderkey AS archive, CAST(l_linenumber % 2 AS BIGINT) AS file_id, l_partkey AS block_id, CAST(l_quantity AS BIGINT) AS len,
            CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS BIGINT) AS block_index, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber % 2) AS total,
            CAST(SUM(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey, l_linenumber % 2) AS BIGINT) AS size,
            COALESCE(CAST(SUM(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM {lineitem})""",
    "verification": "SELECT p_partkey AS block_id, p_partkey % 11 <> 0 AS content_verified, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size * 20 AS BIGINT) END AS verified_raw_len FROM {part}",
    "scan_offsets": "SELECT p_partkey * 4096 AS scan_offset FROM {part} WHERE p_partkey % 11 <> 0 OR p_partkey % 33 = 0",
    "checkpoint_paths": """SELECT o_orderkey AS archive, x.file_id, CAST(o_custkey AS BIGINT) AS seq, 'check/' || CAST(x.file_id AS STRING) AS path, CASE WHEN o_orderkey % 23 = 0 THEN 'bad' ELSE md5('check/' || CAST(x.file_id AS STRING)) END AS path_digest
        FROM {orders} CROSS JOIN (SELECT CAST(0 AS BIGINT) AS file_id UNION ALL SELECT CAST(1 AS BIGINT)) x WHERE o_orderkey % 3 = 2""",
    "dictionary_copies": """SELECT o_orderkey AS archive, x.copy, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN x.copy = 2 AND o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS generation, 'a' || CAST(o_orderkey + CASE WHEN x.copy = 1 AND o_orderkey % 10 = 5 THEN 1 ELSE 0 END AS STRING) AS instance,
        'a' || CAST(o_orderkey AS STRING) AS expected_instance, o_orderkey % 9 <> 0 OR x.copy = 2 AS body_ok FROM {orders} CROSS JOIN (SELECT 1 AS copy UNION ALL SELECT 2) x WHERE o_orderkey % 3 = 0""",
    "dictionary_entries": """SELECT o_orderkey AS archive, x.copy, y.path_id, 'dict/' || CAST(y.path_id AS STRING) || CASE WHEN x.copy = 2 AND o_orderkey % 8 = 4 THEN 'x' ELSE '' END AS path,
        md5('dict/' || CAST(y.path_id AS STRING) || CASE WHEN x.copy = 2 AND o_orderkey % 8 = 4 THEN 'x' ELSE '' END) || CASE WHEN o_orderkey % 21 = 0 AND y.path_id = 1 THEN '!' ELSE '' END AS path_digest
        FROM {orders} CROSS JOIN (SELECT 1 AS copy UNION ALL SELECT 2) x CROSS JOIN (SELECT CAST(0 AS BIGINT) AS path_id UNION ALL SELECT CAST(1 AS BIGINT)) y WHERE o_orderkey % 3 = 0""",
    "archives": "SELECT o_orderkey AS archive, o_orderkey % 5 = 0 AS index_valid FROM {orders}",
    "roots": "SELECT r_regionkey AS root_id, r_name AS root_name FROM {region}",
}


def tables(text: str) -> list[str]:
    return sorted(set(re.findall(r"{(\w+)}", text)))


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view over the tables of a folder."""
    text = VIEWS[view]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables(text)})


def duck(sql: str) -> str:
    """An oracle with the views it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    views = ", ".join(f"{v} AS ({VIEWS[v].format(**{t: t for t in tables(VIEWS[v])})})" for v in used)
    if not views:
        return sql
    return f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"
