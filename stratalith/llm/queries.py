"""The opN_<name> queries over the driver tables: thin wrappers that derive the reported columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, html_extract, language_id, masked_lm, ngram_join, packing, quality_fm, quality_rules, storage, suffix_dedup, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    storage.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_read(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op7_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents")).drop("n_class")


def op8_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op9_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_robust_outliers, op2_suffix_dedup, op3_best_fit_packing, op4_warc_chunks, op5_language_id, op6_decontaminate, op7_partenum_join, op8_html_templates, op9_factorisation_machine, op10_masked_lm)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

_OP4 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN p.page_id < g.top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN p.page_id < g.top THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.payload_bytes >= 1000 AND p.payload_digest = g.payload_digest"""

_OP6 = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS s, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, s, array_to_string(w[k:k + s - 1], ' ') AS win FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS k FROM d, (SELECT DISTINCT s FROM bw) WHERE len(w) >= s)),
m AS (SELECT dw.doc_id, dw.k, dw.s, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + s)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""

_OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.root FROM reach r JOIN both_ways l ON r.doc_id = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) r ON d.doc_id = r.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Models, packing and byte-level repeats are not SQL; tests hold them to brute-force versions."""
    return {"op4_warc_chunks": _OP4, "op6_decontaminate": _OP6, "op7_partenum_join": _OP7}
