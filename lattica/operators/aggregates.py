"""Grouping and scalar aggregates, as values or as datasets of one row.

Sums of nothing are 0 and keep their column's type, an overflow raises; the
minimum, maximum and average of nothing are null, or raise with strict=True.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.errors import EmptySequence, MoreThanOne

RESULT = "result"


def group_by(df: DataFrame, keys: Sequence, aggregates: dict[str, Column] | None = None, element: Column | None = None) -> DataFrame:
    """Groups by key: with aggregates a row of results, else the array ``group`` of rows (or elements)."""
    grouped = df.groupBy(*keys)
    if aggregates:
        return grouped.agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.agg(F.collect_list(F.struct(*df.columns) if element is None else element).alias("group"))


def group_by_normalised(df: DataFrame, key: str, normal: Column, aggregates: dict[str, Column], name: str = "key") -> DataFrame:
    """Groups keys that a comparer holds equal: by a normal form, shown by the smallest key of the group."""
    return df.groupBy(normal.alias("lattica_key")).agg(F.min(key).alias(name), *[c.alias(n) for n, c in aggregates.items()]).drop("lattica_key")


def map_reduce(df: DataFrame, items: Column, key: Callable[[Column], Column], aggregates: dict[str, Column]) -> DataFrame:
    """Explodes ``items`` to ``item``, groups by a key of it and aggregates."""
    mapped = df.select(F.explode(items).alias("item"))
    return mapped.groupBy(key(F.col("item")).alias("key")).agg(*[c.alias(n) for n, c in aggregates.items()])


def count_as_query(df: DataFrame, predicate: Column | None = None, small: bool = True) -> DataFrame:
    """The number of rows (that meet the predicate): an int, whose overflow raises, or with small=False a long."""
    n = F.count("*") if predicate is None else F.count_if(predicate)
    return df.agg((n.cast("int") if small else n).alias(RESULT))


def sum_of(df: DataFrame, column: str | Column) -> Column:
    """Sum in the column's own type; nulls are skipped and nothing sums to 0."""
    own = F.col(column) if isinstance(column, str) else column
    kind = df.select(own.alias("c")).dtypes[0][1]
    total = F.coalesce(F.sum(own), F.lit(0))
    if kind == "float":
        return total.cast("float")
    if kind.startswith("decimal"):
        return total
    return total.cast(kind)


def sum_as_query(df: DataFrame, column: str | Column) -> DataFrame:
    return df.agg(sum_of(df, column).alias(RESULT))


def _or_raise(value: Column, strict: bool, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"EmptySequence: {what} of no values"))) if strict else value


def min_as_query(df: DataFrame, column: str | Column, strict: bool = False) -> DataFrame:
    return df.agg(_or_raise(F.min(column), strict, "min").alias(RESULT))


def max_as_query(df: DataFrame, column: str | Column, strict: bool = False) -> DataFrame:
    return df.agg(_or_raise(F.max(column), strict, "max").alias(RESULT))


def average_as_query(df: DataFrame, column: str | Column, strict: bool = False) -> DataFrame:
    """Mean of the non-null values: float for floats, decimal for decimals, else double."""
    own = F.col(column) if isinstance(column, str) else column
    kind = df.select(own.alias("c")).dtypes[0][1]
    mean = F.avg(own).cast("float") if kind == "float" else F.avg(own)
    return df.agg(_or_raise(mean, strict, "average").alias(RESULT))


def any_as_query(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    found = (df if predicate is None else df.where(predicate)).limit(1)
    return found.agg((F.count("*") > 0).alias(RESULT))


def all_as_query(df: DataFrame, predicate: Column) -> DataFrame:
    """True for no rows; a null outcome counts as false."""
    failing = df.where(~F.coalesce(predicate, F.lit(False))).limit(1)
    return failing.agg((F.count("*") == 0).alias(RESULT))


def contains_as_query(df: DataFrame, column: str, value, normal: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Whether a row's value equals the given one (null equals null), under a normal form if one is given."""
    return any_as_query(df, normal(F.col(column)).eqNullSafe(normal(F.lit(value))))


def first_as_query(df: DataFrame, order: Sequence, predicate: Column | None = None) -> DataFrame:
    found = df if predicate is None else df.where(predicate)
    return found.orderBy(*order).limit(1)


def last_as_query(df: DataFrame, opposite: Sequence, predicate: Column | None = None) -> DataFrame:
    """The first row in the opposite order."""
    return first_as_query(df, opposite, predicate)


def single_as_query(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """The only row, or none; several fail with MoreThanOne when the query runs."""
    found = (df if predicate is None else df.where(predicate)).limit(2)
    several = F.count("*").over(Window.partitionBy(F.lit(0))) > 1
    checked = found.withColumn("lattica_one", F.when(several, F.raise_error(F.lit("MoreThanOne: the dataset has several rows"))).otherwise(F.lit("")))
    return checked.where(F.col("lattica_one").isNotNull()).drop("lattica_one")


def value(query: DataFrame):
    """The only value of a dataset of one row."""
    return _raising(query.first)[0]


def _raising(action: Callable):
    """Runs an action; what a query's own checks raise comes as this engine's errors."""
    try:
        return action()
    except PySparkException as failed:
        for kind in (EmptySequence, MoreThanOne):
            if f"{kind.__name__}: " in str(failed):
                raise kind(kind.__name__ + str(failed).partition(kind.__name__)[2].partition("\n")[0]) from None
        raise


def one(query: DataFrame, default: bool = False, single: bool = False):
    """The row of a positional query; none raises EmptySequence (or gives None), several raise MoreThanOne."""
    rows = _raising(lambda: query.take(2))
    if single and len(rows) > 1:
        raise MoreThanOne("the dataset has several rows")
    if not rows:
        if default:
            return None
        raise EmptySequence("the dataset has no rows")
    return rows[0]
