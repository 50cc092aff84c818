"""Positional operators: they need a total order, which the caller names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.errors import NameClash, NotOrdered, OrderRequired
from lattica.session import reliable

#: monotonically_increasing_id() has the partition above these bits and the row in it below.
ROW_BITS = 33
#: A row's place inside the operators; outside it is ``idx``.
PLACE = "lattica_place"
#: Rows that a top-k may hold for one place.
TOP_PLACES = 10_000


def _keys(order: Sequence) -> list[Column]:
    if not order:
        raise OrderRequired("a positional operator needs order_by")
    return [F.col(k) if isinstance(k, str) else k for k in order]


def with_index(df: DataFrame, order: Sequence, name: str = "idx") -> DataFrame:
    """df with each row's place in the order, from 0, as a long.

    Rows are range-partitioned and sorted, then fixed in reliable storage; a
    place is the partition's offset plus the row's place in it, so there is no
    single-partition window.  What reaches the driver is a count per partition.
    """
    keys = _keys(order)
    if name in df.columns:
        raise NameClash(f"the dataset has a column {name!r} already")
    placed = reliable(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("lattica_id", F.monotonically_increasing_id()))
    part = F.shiftright("lattica_id", ROW_BITS).cast("int")
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(k, 0)
    before = F.get(F.lit(offsets) if offsets else F.array(F.lit(0)), part).cast("long")
    return placed.withColumn(name, before + F.col("lattica_id").bitwiseAND((1 << ROW_BITS) - 1)).drop("lattica_id")


def placed_rows(df: DataFrame, order: Sequence) -> DataFrame:
    """df with each row's place in PLACE, and in ``idx`` for expressions of the caller's.

    A column ``idx`` of df's own is kept, and is what such expressions mean.
    """
    indexed = with_index(df, order, PLACE)
    return indexed if "idx" in df.columns else indexed.withColumn("idx", F.col(PLACE))


def _bound(indexed: DataFrame, failing: Column) -> int | None:
    """The first place at which the predicate fails."""
    return indexed.where(failing).agg(F.min(PLACE)).first()[0]


def _finished(df: DataFrame, out: DataFrame, keep_index: bool) -> DataFrame:
    return out.drop(PLACE) if keep_index or "idx" in df.columns else out.drop(PLACE, "idx")


def _fails(predicate: Column) -> Column:
    return ~F.coalesce(predicate, F.lit(False))


def take_while(df: DataFrame, order: Sequence, predicate: Column, keep_index: bool = False) -> DataFrame:
    """The longest prefix on which the predicate holds; it may use ``idx``, the place (or df's own column of that name)."""
    indexed = placed_rows(df, order)
    bound = _bound(indexed, _fails(predicate))
    out = indexed if bound is None else indexed.where(F.col(PLACE) < bound)
    return _finished(df, out, keep_index)


def skip_while(df: DataFrame, order: Sequence, predicate: Column, keep_index: bool = False) -> DataFrame:
    """All but that prefix."""
    indexed = placed_rows(df, order)
    bound = _bound(indexed, _fails(predicate))
    out = indexed.where(F.lit(False)) if bound is None else indexed.where(F.col(PLACE) >= bound)
    return _finished(df, out, keep_index)


def take(df: DataFrame, order: Sequence, count: int) -> DataFrame:
    """The first rows; with an order this is a distributed top-k."""
    return (df.orderBy(*_keys(order)) if order else df).limit(count)


def skip(df: DataFrame, order: Sequence, count: int) -> DataFrame:
    return with_index(df, order, PLACE).where(F.col(PLACE) >= count).drop(PLACE)


def element_at(df: DataFrame, order: Sequence, place: int) -> DataFrame:
    """The row at a place, if there is one: a top-k where the place is small, else by places."""
    if 0 <= place < TOP_PLACES:
        return df.orderBy(*_keys(order)).offset(place).limit(1)
    return with_index(df, order, PLACE).where(F.col(PLACE) == place).drop(PLACE)


def reversed_keys(order: Sequence) -> list[Column]:
    """The keys in the opposite direction; names sort ascending with nulls first."""
    out = []
    for key in order:
        if isinstance(key, str):
            out.append(F.col(key).desc_nulls_last())
        else:
            raise OrderRequired("reverse needs an order by column names, or give the opposite keys")
    return out


def reverse(df: DataFrame, order: Sequence, opposite: Sequence | None = None) -> DataFrame:
    """The rows in the opposite order."""
    _keys(order)
    return df.orderBy(*(opposite or reversed_keys(order)))


def zip_with(left: DataFrame, left_order: Sequence, right: DataFrame, right_order: Sequence) -> DataFrame:
    """Rows paired by place, up to the shorter; columns are ``left`` and ``right`` structs and ``idx``."""
    a = with_index(left, left_order, PLACE).select(F.col(PLACE).alias("idx"), F.struct(*left.columns).alias("left"))
    b = with_index(right, right_order, PLACE).select(F.col(PLACE).alias("idx"), F.struct(*right.columns).alias("right"))
    return a.join(b, "idx")


def sequence_equal(left: DataFrame, left_order: Sequence, right: DataFrame, right_order: Sequence) -> DataFrame:
    """One row: whether both have equal rows (nulls equal) in the same places."""
    a = with_index(left, left_order, PLACE).select(F.col(PLACE).alias("idx"), F.struct(*left.columns).alias("a"))
    b = with_index(right, right_order, PLACE).select(F.col(PLACE).alias("idx"), F.struct(*right.columns).alias("b"))
    both = a.join(b, "idx", "full").select(F.col("a").eqNullSafe(F.col("b")).alias("same"))
    return both.agg(F.coalesce(F.bool_and("same"), F.lit(True)).alias("result"))


def check_order_by(df: DataFrame, order: Sequence, partition_by: Sequence = ()) -> DataFrame:
    """df, if the keys rise within each partition of Spark's (or each group of ``partition_by``); else NotOrdered.

    The rows are fixed in reliable storage first, so those that are checked now
    are those that come back.  Nulls come first, NaN last.
    """
    names = [k for k in order if isinstance(k, str)]
    if len(names) != len(order) or not names:
        raise OrderRequired("check_order_by needs column names")
    fixed = reliable(df.withColumn("lattica_id", F.monotonically_increasing_id()))
    row = F.struct(*names)
    window = Window.partitionBy(*(partition_by or [F.shiftright("lattica_id", ROW_BITS)])).orderBy("lattica_id")
    if fixed.select((F.lag(row).over(window) > row).alias("bad")).where("bad").limit(1).count():
        raise NotOrdered(", ".join(names))
    return fixed.drop("lattica_id")
