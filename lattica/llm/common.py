"""What the operators of this subpackage share: tables, checkpoints, words."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a worker turns into Python values at once; texts can be long, so fewer than come in a batch.
SLICE_ROWS = 256
#: Bytes of text that are tokenised at once.
BLOCK_BYTES = 2 << 20
#: Shuffle files go when a cut is written, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
    + [0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165],
    dtype=np.uint64,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """A checkpoint folder where the cluster names none (tests)."""
    if shared_folder(spark) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the cluster names for checkpoints, or the one set on the context."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage: what made them is not run again, and its shuffle files go."""
    spark = df.sparkSession
    prepare(spark)
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, which reads the setting
    finally:
        spark.conf.set(_CLEANUP, was)


def drop(df: DataFrame) -> None:
    """Deletes the files of a cut that nothing reads any more; Spark's cleaner would find them later, if set to."""
    files = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if files.isDefined():
        remove(df.sparkSession, files.get())


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def through(df: DataFrame, fields: str, work: Callable[[], Callable[[list], dict]], column: str = "text", kept: list[str] | None = None) -> DataFrame:
    """df's ``kept`` columns (by default all but ``column``) and ``fields``, which Python makes of ``column``.

    Kept columns stay Arrow arrays, so nulls and large integers come through as
    they are.  work() runs once a task and returns what maps a list of at most
    SLICE_ROWS values (UTF-8 bytes for a string column) to lists by field name.
    """
    kept = [c for c in df.columns if c != column] if kept is None else kept
    types = {f.name: f for f in df.schema.fields}
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([*(types[c] for c in kept), *made.fields])
    arrow = to_arrow_schema(made)
    text = isinstance(types[column].dataType, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                values = part.column(column)
                found = step((values.cast(pa.large_binary()) if text else values).to_pylist())
                own = [pa.array(found[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *own], names=[f.name for f in schema.fields])

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, column])]).mapInArrow(run, schema)


def crc_bucket(column: str = "doc_id"):
    """crc32(id as text) mod 5; 0 marks the held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words; runs of different sizes differ."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, size, np.uint64) * _MIX[9]
    for k in range(size):
        total += hashes[k : k + count] * _MIX[k % 10] + np.uint64(k)
    return finish(total)


def in_blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK_BYTES each, so that one batch's words needn't be held at once."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= BLOCK_BYTES:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def known(texts: list[bytes | None]) -> list[bytes]:
    """The texts, null ones empty."""
    return [t or b"" for t in texts]
