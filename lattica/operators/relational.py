"""Projection, filtering, joins and set operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.ordering import placed_rows


def select_many(df: DataFrame, items: Column, name: str = "item", keep: Sequence[str] | None = None) -> DataFrame:
    """A row per element of an array expression, with the parent's columns (or those in ``keep``) beside it."""
    parent = list(df.columns if keep is None else keep)
    return df.select(*parent, F.explode(items).alias(name))


def select_indexed(df: DataFrame, order: Sequence, *columns: Column) -> DataFrame:
    """Projection whose expressions may use ``idx``, the row's place (or df's own column of that name)."""
    return placed_rows(df, order).select(*columns)


def where_indexed(df: DataFrame, order: Sequence, predicate: Column) -> DataFrame:
    """Rows that meet a predicate, which may use ``idx`` in the same way."""
    return placed_rows(df, order).where(predicate).select(*[F.col(f"`{c}`") for c in df.columns])


def select_many_indexed(df: DataFrame, order: Sequence, items: Column, name: str = "item", keep: Sequence[str] | None = None) -> DataFrame:
    """select_many with the parent's place in ``idx`` (a column ``idx`` of df's own stays as it is)."""
    kept = df.columns if keep is None else list(keep)
    return select_many(placed_rows(df, order), items, name, kept if "idx" in kept else ["idx", *kept])


def key_match(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], null_safe: bool = True) -> Column:
    """Equality of the keys; null keys match each other unless null_safe is off."""
    match = F.lit(True)
    for a, b in zip(left_keys, right_keys, strict=True):
        match = match & (left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b])
    return match


def join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], result: Callable | None = None, null_safe: bool = True, how: str = "inner") -> DataFrame:
    """Equi-join; ``result`` maps both inputs to the output's columns.

    Catalyst picks the strategy by size; with adaptive execution a small side is
    broadcast and a skewed key is split.  A dataset may be joined to itself.
    """
    right = right.toDF(*right.columns)  # columns of its own, where both sides are one dataset
    out = left.join(right, key_match(left, right, left_keys, right_keys, null_safe), how)
    return out.select(*result(left, right)) if result else out


def group_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], aggregates: dict[str, Column] | None = None, null_safe: bool = True) -> DataFrame:
    """Each left row with its matches: aggregates over them, or the array ``group`` of right rows (empty if none).

    Aggregates are computed on the right side before the join; a left row
    without matches gets what they give for no rows: 0 for a count, null for
    F.sum, F.min or F.max, and 0 for aggregates.sum_of.
    """
    right = right.toDF(*right.columns)
    names = [f"lattica_k{k}" for k in range(len(right_keys))]
    grouped = right.groupBy(*[F.col(k).alias(n) for k, n in zip(right_keys, names, strict=True)])
    gathered = grouped.agg(*([c.alias(n) for n, c in aggregates.items()] if aggregates else [F.collect_list(F.struct(*right.columns)).alias("group")]))
    gathered = gathered.withColumn("lattica_found", F.lit(True))
    joined = left.join(gathered, key_match(left, gathered, left_keys, names, null_safe), "left").drop(*names)
    if aggregates:
        none = right.sparkSession.createDataFrame([], right.schema).agg(*[c.alias(f"lattica_none_{n}") for n, c in aggregates.items()])
        values = {n: F.when(F.col("lattica_found"), F.col(n)).otherwise(F.col(f"lattica_none_{n}")) for n in aggregates}
        filled = joined.crossJoin(F.broadcast(none)).withColumns(values)  # one row
        return filled.drop("lattica_found", *none.columns)
    empty = F.array().cast(dict(gathered.dtypes)["group"])
    return joined.drop("lattica_found").withColumn("group", F.coalesce("group", empty))


def semi(left: DataFrame, right: DataFrame, left_keys, right_keys, null_safe: bool = True) -> DataFrame:
    return left.join(right, key_match(left, right, left_keys, right_keys, null_safe), "left_semi")


def anti(left: DataFrame, right: DataFrame, left_keys, right_keys, null_safe: bool = True) -> DataFrame:
    return left.join(right, key_match(left, right, left_keys, right_keys, null_safe), "left_anti")


def cross_product(left: DataFrame, right: DataFrame, predicate: Column | None = None, result: Callable | None = None) -> DataFrame:
    """Every pair of rows that meets the predicate; Spark broadcasts a side that is small enough."""
    out = left.crossJoin(right) if predicate is None else left.join(right, predicate)
    return out.select(*result(left, right)) if result else out


def concat(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of the inputs, repeated ones included."""
    for other in others:
        first = first.unionByName(other)
    return first


def distinct(df: DataFrame, key: Column | None = None, prefer: Column | None = None) -> DataFrame:
    """Distinct rows; with a normalised key, one row per key, the smallest by ``prefer``."""
    if key is None:
        return df.distinct()
    row = F.struct(*df.columns)
    best = df.groupBy(key.alias("lattica_key")).agg(F.min_by(row, prefer if prefer is not None else row).alias("r"))
    return best.select("r.*")


def union(first: DataFrame, other: DataFrame, key: Column | None = None) -> DataFrame:
    return distinct(first.unionByName(other), key)


def intersect(first: DataFrame, other: DataFrame, key: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    if key is None:
        return first.intersect(other.select(first.columns))
    return distinct(_keyed(first, other, key, "left_semi"), key(first))


def except_(first: DataFrame, other: DataFrame, key: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    if key is None:
        return first.subtract(other.select(first.columns))
    return distinct(_keyed(first, other, key, "left_anti"), key(first))


def _keyed(first: DataFrame, other: DataFrame, key, how: str) -> DataFrame:
    """first's rows with (or without) a row of other that has the same normalised key."""
    own = other.select(key(other).alias("lattica_key")).distinct()
    return first.join(own, key(first).eqNullSafe(own["lattica_key"]), how)
