"""The registered queries of this subpackage: each applies an operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import angular_negatives, curriculum, jaccard_partenum, katz_backoff, language_crf, latent_leaks, length_packing, pii_votes, quality_trees, repeated_windows, rule_limits, secret_automata, setm_phrases


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_jaccard_partenum(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_partenum.components(documents(spark, folder))


def op2_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_windows.remove(documents(spark, folder), with_text=False)


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet")


def op3_latent_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return latent_leaks.leaks(documents(spark, folder), benchmark(spark, folder))


def op4_secret_automata(spark: SparkSession, folder: str) -> DataFrame:
    return secret_automata.digest(secret_automata.scan(documents(spark, folder)))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def op5_quality_trees(spark: SparkSession, folder: str) -> DataFrame:
    return quality_trees.score(documents(spark, folder), labels(spark, folder))


def op6_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    return language_crf.predict(documents(spark, folder))


def op7_rule_limits(spark: SparkSession, folder: str) -> DataFrame:
    return rule_limits.judge(documents(spark, folder), labels(spark, folder))


def op8_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    mixed = curriculum.mix(documents(spark, folder)).select("doc_id", *curriculum.ADDED)
    # times are compared with SQL, whose last digits may differ
    return mixed.withColumns({c: F.round(c, 9) for c in ("position", "position_2")})


def op9_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return katz_backoff.score(documents(spark, folder))


def op10_pii_votes(spark: SparkSession, folder: str) -> DataFrame:
    return pii_votes.digest(pii_votes.scan(documents(spark, folder)))


def op11_length_packing(spark: SparkSession, folder: str) -> DataFrame:
    return length_packing.pack(documents(spark, folder), with_ids=False)


def op12_angular_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return angular_negatives.mine(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_setm_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return setm_phrases.collocations(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_partenum": op1_jaccard_partenum,
    "op2_repeated_windows": op2_repeated_windows,
    "op3_latent_leaks": op3_latent_leaks,
    "op4_secret_automata": op4_secret_automata,
    "op5_quality_trees": op5_quality_trees,
    "op6_language_crf": op6_language_crf,
    "op7_rule_limits": op7_rule_limits,
    "op8_curriculum": op8_curriculum,
    "op9_katz_backoff": op9_katz_backoff,
    "op10_pii_votes": op10_pii_votes,
    "op11_length_packing": op11_length_packing,
    "op12_angular_negatives": op12_angular_negatives,
    "op13_setm_phrases": op13_setm_phrases,
}
