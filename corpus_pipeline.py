"""From documents to token files: language ID, near copies, benchmark passages, source weights, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
scratch folder and read again as the next stage's docs. Every decision takes effect on all rows its
predecessor kept; all stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.llm import decontaminate, jaccard, language, mixing, shared, token_files


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays open, go."""
    return language.keep_identified(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id."""
    return jaccard.one_of_each(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as the weights of their sources ask."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every copy, from the files written."""
    return token_files.tokens_of(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", join_near_copies),
    ("decontamination", remove_benchmark_passages),
    ("source_mix", mix_sources),
    ("token_files", write_token_files),
]

#: Language ID and byte-pair encoding can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with shared.scope(spark):
            docs, path = shared.kept(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            shared.discard(spark, last)
        last = path
    return docs
