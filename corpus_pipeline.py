"""A training-corpus pipeline over the documents table, from raw texts to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; ``run`` writes each as Parquet in the shared folder and reads it back for the
next. All but the last return the columns of documents:

1. language_id: documents without an identified language go.
2. ngram_join: of documents linked by word five-grams with a similarity of 0.8 or more, the
   one with the least id stays.
3. suffix_dedup: bytes covered by 100-byte strings that start earlier are cut out.
4. decontaminate: documents in which a benchmark window occurs go.
5. packing: the rest is tokenised and packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalith.llm import decontaminate, language_id, ngram_join, packing, storage, suffix_dedup

#: Words of a shingle and least percent of similarity of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.prepare(spark)
    return language_id.keep_identified(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.prepare(spark)
    return ngram_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def dedup_suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.prepare(spark)
    return suffix_dedup.remove(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.prepare(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.prepare(spark)
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("ngram_join", join_ngrams), ("suffix_dedup", dedup_suffixes), ("decontaminate", remove_benchmark), ("packing", pack_sequences)]

#: No stage but the second and fourth could be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
