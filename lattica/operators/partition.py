"""Explicit partitioning, functions over partitions and datasets, forks and loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lattica.errors import BadIteration, BadPartitionCount, BadSeparators, PartitionMismatch
from lattica.session import reliable

#: Bytes of a dataset that a per-partition function may get whole in each task.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 200_000
#: Rows of a batch where Spark doesn't cut them.
BATCH_ROWS = 10_000


def _count(n: int | None) -> None:
    if n is not None and n < 1:
        raise BadPartitionCount(f"{n} partitions")


def hash_partition(df: DataFrame, keys: Sequence, count: int | None = None, result: Sequence[Column] | None = None) -> DataFrame:
    """Rows with equal keys share a partition; a projection moves only its own columns."""
    _count(count)
    moved = df.repartition(count, *keys) if count else df.repartition(*keys)
    return moved.select(*result) if result else moved


def range_partition(df: DataFrame, keys: Sequence, count: int | None = None) -> DataFrame:
    """Ranges of about equal size, from Spark's sample of the keys; Column keys may descend."""
    _count(count)
    return df.repartitionByRange(count, *keys) if count else df.repartitionByRange(*keys)


def check_separators(separators: Sequence, descending: bool = False) -> list:
    """The separators as a list; they must run in the key's direction (equal neighbours may follow each other)."""
    values = list(separators)
    if not values or any(v is None for v in values):
        raise BadSeparators("range separators are missing")
    pairs = list(zip(values, values[1:], strict=False))
    if any(a < b for a, b in pairs) if descending else any(a > b for a, b in pairs):
        raise BadSeparators("range separators are out of order")
    return values


def range_id(key: Column, separators: Sequence, descending: bool = False) -> Column:
    """The partition of a key: the number of separators before it, so a key equal to one goes to its left."""
    values = F.lit(check_separators(separators, descending))
    return F.size(F.filter(values, (lambda s: s > key) if descending else (lambda s: s < key)))


def range_partition_by(df: DataFrame, key: Column, separators: Sequence, descending: bool = False) -> DataFrame:
    """One partition more than separators; a null key goes to the first."""
    pid = F.coalesce(range_id(key, separators, descending), F.lit(0)).cast("int")
    return df.repartitionById(len(separators) + 1, pid)


def assume_partition(df: DataFrame, separators: Sequence | None = None, count: int | None = None) -> DataFrame:
    """df unchanged: Catalyst keeps its own account of partitioning.  Separators are checked against the count."""
    if separators is not None:
        values = check_separators(separators)
        if count is not None and len(values) != count - 1:
            raise BadSeparators(f"{len(values)} separators for {count} partitions")
    return df


def apply_per_partition(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    return df.mapInPandas(function, schema)


def apply_with_partition_index(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """function(batches, partition index) on each partition."""

    def run(batches):
        yield from function(batches, TaskContext.get().partitionId())

    return df.mapInPandas(run, schema)


def apply_whole(df: DataFrame, function: Callable, schema: str, order: Sequence = ()) -> DataFrame:
    """function over the whole dataset, in order if one is given: one task streams through all rows."""
    single = df.repartition(1)
    return (single.sortWithinPartitions(*order) if order else single).mapInPandas(function, schema)


def _frames(df: DataFrame, part: Column) -> DataFrame:
    return df.withColumn("lattica_part", part)


def apply_binary_whole(left: DataFrame, right: DataFrame, function: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """function over both whole datasets, in one task."""
    return _cogroup(_frames(left, F.lit(0)), _frames(right, F.lit(0)), function, schema)


def apply_pairwise(left: DataFrame, right: DataFrame, function: Callable, schema: str) -> DataFrame:
    """function over the partitions of both with the same number; the counts must be equal."""
    return apply_per_partition_many([left, right], lambda frames: function(*frames), schema)


def apply_per_partition_many(frames: Sequence[DataFrame], function: Callable[[list[pd.DataFrame]], pd.DataFrame], schema: str) -> DataFrame:
    """function over the partitions with the same number of several datasets, of one schema or several.

    The datasets are fixed in reliable storage first, so partitions stay as they are counted.
    """
    frames = [reliable(f) for f in frames]
    counts = [f.rdd.getNumPartitions() for f in frames]
    if len(set(counts)) > 1:
        raise PartitionMismatch(f"{', '.join(map(str, counts))} partitions")
    union, split = _beside(frames)
    out = to_arrow_schema(union.sparkSession.createDataFrame([], schema).schema)
    return union.groupBy("lattica_part").applyInArrow(lambda table: pa.Table.from_pandas(function(split(table)), out, preserve_index=False), schema)


def _beside(frames: Sequence[DataFrame]) -> tuple[DataFrame, Callable[[pa.Table], list[pd.DataFrame]]]:
    """Rows of several datasets in one, each in columns of its own, and what takes them apart again."""
    names, tagged = [f.columns for f in frames], []
    for k, f in enumerate(frames):
        plain = f.toDF(*[f"c{k}_{j}" for j in range(len(f.columns))])
        tagged.append(plain.withColumns({"lattica_source": F.lit(k), "lattica_part": F.spark_partition_id()}))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

    def split(table: pa.Table) -> list[pd.DataFrame]:
        parts = []
        for k, own in enumerate(names):
            rows = table.filter(pc.equal(table["lattica_source"], k)).select([f"c{k}_{j}" for j in range(len(own))])
            parts.append(rows.rename_columns(own).to_pandas())
        return parts

    return union, split


def _cogroup(left: DataFrame, right: DataFrame, function: Callable, schema: str) -> DataFrame:
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return function(a.drop(columns="lattica_part"), b.drop(columns="lattica_part"))

    return left.groupBy("lattica_part").cogroup(right.groupBy("lattica_part")).applyInPandas(run, schema)


def apply_many(frames: Sequence[DataFrame], function: Callable[[list[pd.DataFrame]], pd.DataFrame], schema: str) -> DataFrame:
    """function over several whole datasets, of one schema or several, in one task; a dataset may be empty."""
    union, split = _beside(frames)
    given = to_arrow_schema(union.schema)
    out = to_arrow_schema(union.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        table = pa.Table.from_batches(rows) if rows else given.empty_table()
        yield from pa.Table.from_pandas(function(split(table)), out, preserve_index=False).to_batches()

    return union.repartition(1).mapInArrow(run, schema)


def _small(df: DataFrame) -> bool:
    """Whether the dataset may be broadcast: counted and measured where it lies, nothing is collected."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    n, total = df.agg(F.count("*"), size).first()
    return n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES


def apply_with_broadcast(df: DataFrame, other: DataFrame, function: Callable, schema: str) -> DataFrame:
    """function(batches of a partition, whole other dataset), once for each partition.

    The other dataset is sent to the tasks where it has few rows and bytes; else
    each partition's rows are cogrouped with a copy of it, by shuffle, and go to
    the function in batches as well.
    """
    if _small(other):
        shared = df.sparkSession.sparkContext.broadcast(other.toPandas())

        def run(batches):
            yield from function(batches, shared.value)

        return df.mapInPandas(run, schema)
    fixed = reliable(df)  # its partitions stay as they are counted
    parts = fixed.rdd.getNumPartitions()
    copies = other.withColumn("lattica_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = a.drop(columns="lattica_part")
        batches = (rows[k : k + BATCH_ROWS].reset_index(drop=True) for k in range(0, len(rows), BATCH_ROWS))
        return pd.concat(list(function(batches, b.drop(columns="lattica_part"))))

    return _frames(fixed, F.spark_partition_id()).groupBy("lattica_part").cogroup(copies.groupBy("lattica_part")).applyInPandas(both, schema)


def broadcast_copies(df: DataFrame, count: int) -> DataFrame:
    """``count`` copies of the dataset, numbered in ``copy``, a partition each."""
    _count(count)
    copied = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return copied.repartitionById(count, F.col("copy").cast("int"))


class Forked:
    """Several datasets from one pass: the mapped rows are persisted until release()."""

    def __init__(self, shared: DataFrame, branches: dict):
        self._shared, self._branches = shared, branches

    def __getitem__(self, key) -> DataFrame:
        return self._branches[key]

    def __iter__(self):
        return iter(self._branches.values())

    def keys(self):
        return self._branches.keys()

    def release(self) -> None:
        self._shared.unpersist()


def fork(df: DataFrame, **branches: Column) -> Forked:
    """Named struct expressions, evaluated once; a branch has the rows whose struct isn't null."""
    shared = df.select(*[c.alias(n) for n, c in branches.items()]).persist()
    return Forked(shared, {n: shared.where(F.col(n).isNotNull()).select(f"{n}.*") for n in branches})


def fork_per_partition(df: DataFrame, function: Callable, schemas: dict[str, str]) -> Forked:
    """function(batches) yields (branch, rows): several datasets from one pass over each partition."""
    names = list(schemas)

    def run(batches):
        for branch, rows in function(batches):
            yield pd.DataFrame({n: rows.to_dict("records") if n == branch else [None] * len(rows) for n in names})

    shared = df.mapInPandas(run, ", ".join(f"{n} struct<{s}>" for n, s in schemas.items())).persist()
    return Forked(shared, {n: shared.where(F.col(n).isNotNull()).select(f"{n}.*") for n in names})


def fork_by_key(df: DataFrame, key: Column, keys: Sequence) -> Forked:
    """A dataset per key; rows with other keys belong to none."""
    shared = df.withColumn("lattica_key", key).where(F.col("lattica_key").isin(list(keys))).persist()
    return Forked(shared, {k: shared.where(F.col("lattica_key") == F.lit(k)).drop("lattica_key") for k in keys})


def do_while(df: DataFrame, body: Callable[[DataFrame], DataFrame], condition: Callable[[DataFrame, DataFrame], bool], count: int = 1, most: int = 1000) -> DataFrame:
    """Runs body ``count`` times, then goes on while condition(before, after); the test follows the body.

    Each round's result is fixed in reliable storage.  count 0 gives df itself.
    """
    if count < 0:
        raise BadIteration("a negative repeat count")
    if count == 0:
        return df
    for _ in range(most):
        before = df
        for _ in range(count):
            df = body(df)
        df = reliable(df)
        if not condition(before, df):
            return df
    raise BadIteration(f"the loop went on for {most} rounds")


def changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether two datasets differ as bags of rows."""
    return bool(after.exceptAll(before).limit(1).count() or before.exceptAll(after).limit(1).count())
