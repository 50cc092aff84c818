"""The registered queries opN_<name> of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import mixing, url_cascade, warc
from lattica.llm.bench_decontam import contamination
from lattica.llm.common import table
from lattica.llm.embedding_dedup import near_vectors
from lattica.llm.html_extract import extract_text
from lattica.llm.license_scan import scan_licenses
from lattica.llm.minhash_dedup import near_duplicates
from lattica.llm.quality import quality_scores
from lattica.llm.toxicity import toxicity_scores


def op1_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"), url_cascade.RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), group="source", alpha=0.5, seed=1)


def op9_bench_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_assembly": op1_warc_assembly,
        "op2_license_scan": op2_license_scan,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_url_cascade": op4_url_cascade,
        "op5_toxicity": op5_toxicity,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_poisson_mix": op8_poisson_mix,
        "op9_bench_decontam": op9_bench_decontam,
        "op10_html_extract": op10_html_extract,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_assembly": warc.ORACLE_SQL,
        "op4_url_cascade": url_cascade.ORACLE_SQL,
        "op8_poisson_mix": mixing.ORACLE_SQL,
    }
