"""User-defined aggregates in two phases: partial states per partition, then one merge per key.

A ColumnAggregate has states that Spark's own aggregates compute, so both
phases stay in the JVM.  A Decomposable is Python: states are folded per
partition, in a table that is flushed when it grows, and only states travel.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Keys whose states a partition holds before it passes them on.
HELD = 50_000


class Decomposable(Protocol):
    """An aggregate by its parts; merge must be associative and commutative."""

    def seed(self, row: tuple) -> Any: ...
    def accumulate(self, state: Any, row: tuple) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def final(self, state: Any) -> Any: ...


@dataclass
class ColumnAggregate:
    """Named states as aggregate expressions, and the result as an expression of their names."""

    states: dict[str, Column]
    result: Callable[[dict[str, Column]], Column]

    def over(self, df: DataFrame, keys: Sequence[str], name: str = "result") -> DataFrame:
        partial = df.groupBy(*keys).agg(*[c.alias(f"lattica_{n}") for n, c in self.states.items()])
        return partial.select(*keys, self.result({n: F.col(f"lattica_{n}") for n in self.states}).alias(name))


def _partial(udaf: Decomposable, keys: list[str], columns: list[str], given):
    """States by key, as (keys, pickled state).  NaN keys are one key; null is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple, Any] = {}

        def flush() -> pa.RecordBatch:
            own = [pa.array([k[j] for k in table], given.field(j).type) for j in range(len(keys))]
            out = pa.RecordBatch.from_arrays([*own, pa.array([pickle.dumps(s) for s in table.values()], pa.binary())], names=given.names)
            table.clear()
            return out

        for batch in batches:
            values = {c: batch.column(c).to_pylist() for c in {*keys, *columns}}
            rows = zip(*(values[c] for c in columns), strict=True)
            names = zip(*(values[k] for k in keys), strict=True) if keys else (() for _ in range(batch.num_rows))
            for key, row in zip(names, rows, strict=True):
                key = tuple(_NAN if k != k else k for k in key)
                table[key] = udaf.accumulate(table[key], row) if key in table else udaf.seed(row)
            if len(table) >= HELD:
                yield flush()
        if table:
            yield flush()

    return run


#: The one NaN of a table's keys, as NaN differs from itself.
_NAN = float("nan")


def _merged(udaf: Decomposable, keys: list[str], given):
    def run(group: pa.Table) -> pa.Table:
        state = None
        for k, packed in enumerate(group["lattica_state"].to_pylist()):
            own = pickle.loads(packed)
            state = udaf.merge(state, own) if k else own
        own = [group[k].slice(0, 1) for k in keys]
        return pa.Table.from_arrays([*own, pa.array([udaf.final(state)], given.field(len(keys)).type)], names=given.names)

    return run


def aggregate_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], udaf: Decomposable, kind: str, name: str = "result") -> DataFrame:
    """(keys, result) of a Python aggregate over the given columns; ``kind`` is the result's type.

    A key's group in the second phase has a state per partition or flush, not its
    rows.  Keys stay Arrow values: large integers beside nulls, NaN and null are
    told apart.
    """
    keys = list(keys)
    types = dict(df.dtypes)
    fields = [f"`{k}` {types[k]}" for k in keys]
    states, results = (T.StructType.fromDDL(", ".join([*fields, last])) for last in ("lattica_state binary", f"`{name}` {kind}"))
    rows = df.select(*keys, *[c for c in columns if c not in keys])
    state = rows.mapInArrow(_partial(udaf, keys, list(columns), to_arrow_schema(states)), states)
    return state.groupBy(*keys).applyInArrow(_merged(udaf, keys, to_arrow_schema(results)), results)


def _folded(df: DataFrame, order: Sequence, column: str, seed, step: Callable, end: Callable, kind: str) -> DataFrame:
    """One task sorts the rows, on disk where they need it, and folds them one after another."""
    schema = T.StructType.fromDDL(f"result {kind}")
    given = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = seed() if callable(seed) else seed
        for batch in batches:
            for value in batch.column("lattica_value").to_pylist():
                state = step(state, value)
        yield pa.RecordBatch.from_arrays([pa.array([end(state)], given.field(0).type)], names=["result"])

    ordered = df.withColumn("lattica_value", F.col(column)).repartition(1).sortWithinPartitions(*order).select("lattica_value")
    return ordered.mapInArrow(run, schema)


def fold_as_query(df: DataFrame, order: Sequence, column: str, seed, step: Callable, kind: str, result: Callable = lambda a: a) -> DataFrame:
    """A left fold in order, as a dataset of one row ``result`` that nothing computes before it is used."""
    return _folded(df, order, column, seed, step, result, kind)


def fold(df: DataFrame, order: Sequence, column: str, seed, step: Callable, result: Callable = lambda a: a):
    """A left fold in order; only its state comes to the driver."""
    rows = _folded(df, order, column, seed, step, cloudpickle.dumps, "binary").collect()
    return result(pickle.loads(rows[0][0]) if rows else (seed() if callable(seed) else seed))


def associative(df: DataFrame, column: str, seed: Callable, merge: Callable, kind: str) -> DataFrame:
    """An associative fold: one partial value per partition, merged at the end.  The seed must be its identity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = seed()
        for batch in batches:
            for value in batch[column]:
                state = merge(state, value)
        yield pd.DataFrame({"result": [state]})

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = seed()
        for batch in batches:
            for value in batch["result"]:
                state = merge(state, value)
        yield pd.DataFrame({"result": [state]})

    partial = df.select(column).mapInPandas(run, f"result {kind}")
    return partial.repartition(1).mapInPandas(last, f"result {kind}")
