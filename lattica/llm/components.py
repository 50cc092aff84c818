"""Connected components by alternating large-star and small-star steps.

Every step is a partial aggregate and an inner join with it.  The large star
meets nodes with very many links, so its aggregate is cut first: both sides of
the join are then plain exchanges, and adaptive execution can split such a node
over tasks.  Links never go to the driver.  Each round ends in a checkpoint,
and the one before it is deleted; rounds end as soon as the links are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, drop

MAX_ROUNDS = 60


def _settled(links: DataFrame) -> bool:
    """Whether every link runs from a leaf to the centre of a star: one link a leaf, and no centre is a leaf."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("w"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("w"), F.lit(0).alias("leaf")))).alias("end"))
    roles = ends.groupBy("end.w").agg(F.sum("end.leaf").alias("up"), F.min("end.leaf").alias("least"))
    return roles.where("up > 1 or up = 1 and least = 0").agg(F.count("*")).first()[0] == 0


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Joins every larger neighbour of a node to the node's smallest neighbour; and the cut that this needs."""
    ends = F.array(F.struct(F.col("u").alias("w"), F.col("v").alias("x")), F.struct(F.col("v").alias("w"), F.col("u").alias("x")))
    both = links.select(F.explode(ends).alias("end")).select("end.w", "end.x")
    least = cut(both.groupBy("w").agg(F.min("x").alias("m")).select(F.col("w").alias("node"), F.least("w", "m").alias("m")))
    larger = links.select(F.col("v").alias("w"), F.col("u").alias("x"))  # links run from u to the smaller v
    return larger.join(least, F.col("w") == F.col("node")).select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v"), least


def _small_star(links: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them; links run from u to the smaller v."""
    least = links.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    moved = links.join(least, F.col("u") == F.col("w")).where("v <> m")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v: long) to (node, component): the smallest node that links reach.

    Nodes without links don't appear.  Null ends and self-links are dropped;
    repeated and mirrored links count once.
    """
    now = cut(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        larger, least = _large_star(now)
        was, now = now, cut(_small_star(larger))
        drop(was)
        drop(least)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))
    return now.select(F.explode(ends).alias("end")).select("end.*").distinct()
