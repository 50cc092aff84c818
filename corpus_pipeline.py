"""The corpus pipeline: quality, toxicity, near duplicates, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir), judges the whole of docs and returns
the rows that it keeps with the columns of documents; the last returns the
mixture, with the number of each copy in ``copy``.  Every row is judged by its
own text, whether it lacks a doc_id or shares it.  Models are fitted on the
labelled rows of docs alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bench_decontam import scanned
from lattica.llm.common import cut, prepare, remove, shared_folder, table
from lattica.llm.minhash_dedup import near_duplicates
from lattica.llm.mixing import poisson_mix
from lattica.llm.quality import KEEP, with_quality
from lattica.llm.toxicity import REJECT, with_toxicity


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows pass through the scorer, so nothing is joined."""
    scored = with_quality(docs, table(spark, sf_dir, "labels"), "lattica_score")
    return scored.where(F.col("lattica_score") >= KEEP).select(_columns(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier calls toxic go; rows pass through the scorer."""
    scored = with_toxicity(docs, table(spark, sf_dir, "labels"), "lattica_score")
    return scored.where(F.col("lattica_score") < REJECT).select(_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a similarity of 0.8 or more one row stays: that with the smallest doc_id, without ids last.

    Rows are told apart by 128 bits of a hash of all their columns; of rows that are equal in all of them one stays.
    Rows without words link with nothing, so all of them stay but repeats of a doc_id.
    """
    seeds = (F.lit("a"), F.lit("b"))
    row = F.concat(*[F.lpad(F.hex(F.xxhash64(seed, *_columns(docs))), 16, "0") for seed in seeds])
    marked = docs.withColumn("lattica_row", row)
    groups = cut(near_duplicates(marked, percent=80, row="lattica_row").select("lattica_row", "kept", F.expr("n_shingles > 0 or doc_id is not null").alias("linked")))
    gone = cut(groups.where("not kept").select("lattica_row").distinct())
    kept = marked.join(gone, "lattica_row", "left_anti")
    repeated = cut(groups.where("kept and linked").groupBy("lattica_row").agg(F.count("*").alias("n")).where("n > 1").select("lattica_row"))
    if repeated.limit(1).count():
        once = kept.join(repeated, "lattica_row", "left_semi").dropDuplicates(["lattica_row"])
        kept = kept.join(repeated, "lattica_row", "left_anti").unionByName(once)
    return kept.select(_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; rows pass through the scan."""
    return scanned(docs, table(spark, sf_dir, "benchmark")).where("lattica.n_hit = 0").select(_columns(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated to shares in proportion to the root of their size, in a global random order."""
    return poisson_mix(docs, group="source", alpha=0.5, seed=1)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("poisson mixture", mixture),
]

#: SQL expresses neither classifiers nor the duplicates' components; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's rows are written and read again in the shared folder.

    A stage's folder goes when the next is written, and all go where a stage
    fails.  The last stays, as the result reads it: the folder is the caller's.
    """
    prepare(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
            docs = spark.read.parquet(f"{folder}/{k}")
    except BaseException:
        remove(spark, folder)
        raise
    return docs
