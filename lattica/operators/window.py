"""Count-based sliding windows over an ordered dataset."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.errors import BadWindow
from lattica.operators.ordering import PLACE, with_index

#: Rows of a block; each block's window runs in one task.
BLOCK = 65_536


def sliding_window(
    df: DataFrame, order: Sequence, size: int, results: dict[str, Column] | None = None, apply: Callable[[Column], Column] | None = None, block: int = BLOCK
) -> DataFrame:
    """One row for each full window of ``size`` consecutive rows: its start ``idx`` and its results.

    results are aggregates over the window's rows; ``apply`` instead maps the
    array of the window's rows to ``result``.  Blocks of places are windowed
    apart: a block also gets the rows after it that its last windows reach.
    """
    if size < 1:
        raise BadWindow(f"a window of {size} rows")
    block = max(block, size)
    indexed = with_index(df, order, PLACE)
    own = F.floor(F.col(PLACE) / block)
    reached = F.when((F.col(PLACE) % block < size - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = indexed.withColumn("lattica_block", F.explode(reached))
    frame = Window.partitionBy("lattica_block").orderBy(PLACE).rowsBetween(0, size - 1)
    if apply is not None:
        results = {"lattica_rows": F.collect_list(F.struct(*df.columns))}
    columns = [column.over(frame).alias(name) for name, column in results.items()]
    full = dealt.select(F.col(PLACE).alias("idx"), "lattica_block", F.count("*").over(frame).alias("lattica_n"), *columns)
    full = full.where((F.col("lattica_n") == size) & (F.floor(F.col("idx") / block) == F.col("lattica_block")))
    if apply is not None:
        return full.select("idx", apply(F.col("lattica_rows")).alias("result"))
    return full.select("idx", *results)
