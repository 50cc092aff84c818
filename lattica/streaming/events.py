"""An extension beyond batch queries: the same counts over a stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_counts(stream: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per key and time window; rows later than ``late`` behind the newest are dropped."""
    timed = stream.withColumn("lattica_time", F.col(time).cast("timestamp")).withWatermark("lattica_time", late)
    counts = timed.groupBy(F.window("lattica_time", width), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def word_counts(stream: DataFrame, text: str = "text") -> DataFrame:
    """Running counts of words."""
    return stream.select(F.explode(F.split(text, " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def run_available(frame: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there now, and ends; the next call goes on where this one ended."""
    frame.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """A folder of parquet files as a stream, in the schema that the files have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
