"""A training-data pipeline over ``documents``: each stage reads what the one before it kept.

Every stage but the last returns the columns of its input; the last adds the words that the
mix takes of each document and the training positions at which it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from punctual.llm import curriculum, jaccard_partenum, language_crf, latent_leaks, secret_automata
from punctual.session import cut_lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no language holds three tenths of the words, go."""
    return language_crf.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 % of their five-word shingles the least id stays."""
    return jaccard_partenum.keep_one(docs, n=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return latent_leaks.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text."""
    return secret_automata.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, in the order of training."""
    return curriculum.mix(docs).where("taken > 0")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: Three stages learn models, which SQL does not express; tests compare the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
