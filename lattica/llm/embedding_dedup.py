"""Near-duplicate vectors: spherical k-means cells and blocked cosine products.

Equal vectors of one label are a class from the start.  Centroids are fitted
per label and dimension on a bounded sample; each class goes to its nearest
cells.  Within a cell, blocks of rows are multiplied in double precision.  A
pair is counted in the home cell of one of its two classes, so once, and only
sums and a spanning set of links leave a block, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, prepare
from lattica.llm.components import components

#: Classes that a cell is meant to hold; a larger cell is cut into blocks of this many.
CELL = 1024
#: Most classes, over all labels, in the sample that centroids are fitted on.
SAMPLE = 16_384
#: Most cells of a label; labels share the sample, and a cell has four classes of it at least.
MOST_CELLS = 4096
ROUNDS = 8


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; deterministic for the rows' order."""
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        home = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    return centres


def _fit(classes: DataFrame, sample: int) -> dict[tuple[int, int], np.ndarray]:
    """Centroids by (label, dimension), from the classes with the smallest hashes."""
    wanted = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = classes.count()
    counts = {(r["label"], r["dim"]): r["n"] for r in wanted.where(F.col("n") > CELL).orderBy(F.desc("n"), "label", "dim").limit(sample // 64).collect()}
    if not counts:
        return {}
    share = min(1.0, sample / max(total, 1))
    rows = classes.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = rows.orderBy(F.xxhash64("node", F.lit(13)), "node").limit(sample).select("label", "dim", "embedding").collect()
    groups: dict[tuple[int, int], list] = {}
    for r in rows:
        groups.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    return {
        key: spherical_kmeans(_unit(own), cells)
        for key, own in groups.items()
        if (cells := min(-(-counts.get(key, 0) // CELL), MOST_CELLS, len(own) // 4)) > 1
    }


def _assign(shared, probes: int):
    """A row for each of a class's nearest cells; the first is its home."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            near = np.empty(len(batch), dtype=object)
            for key, own in batch.groupby(["label", "dim"]):
                centres = shared.value.get(key)
                if centres is None:
                    ranked = np.zeros((len(own), 1), np.int64)
                else:
                    x = _unit(own["embedding"])
                    # A few rows at a time: a row has a product for each of up to MOST_CELLS cells.
                    ranked = np.concatenate([np.argsort(-(x[k : k + 256] @ centres.T), axis=1, kind="stable")[:, :probes] for k in range(0, len(x), 256)])
                for at, cells in zip(own.index, ranked, strict=True):
                    near[at] = cells
            batch["near"] = near
            yield batch[["label", "dim", "node", "copies", "embedding", "near"]]

    return run


def _runs(p: np.ndarray, q: np.ndarray) -> tuple[list, list]:
    """The distinct values of p, which is in order, and the values of q beside each."""
    if not len(p):
        return [], []
    begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return list(p[begin]), np.split(q, begin[1:])


def _products(threshold: float):
    """For two blocks of a cell: each class's linked copies, and links that span the block's groups."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, left, right = key[2], key[3], key[4]
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        x = _unit(rows["embedding"])
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        block = rows["block"].to_numpy()
        home = np.array([n[0] for n in rows["near"]])
        width = max(len(n) for n in rows["near"])
        near = np.array([list(n) + [-1] * (width - len(n)) for n in rows["near"]])
        a = np.flatnonzero(block == left)
        b = np.flatnonzero(block == right)
        linked = np.zeros(len(rows), np.int64)
        group = np.arange(len(rows))
        out = []
        for k in range(0, len(a), 256):
            part = a[k : k + 256]
            p, q = np.nonzero(x[part] @ x[b].T >= threshold)
            p, q = part[p], b[q]
            if left == right:
                p, q = p[p < q], q[p < q]
            # p is at home here; where q's home sees p as well, the smaller cell counts the pair.
            elsewhere = home[q]
            also = (near[p] == elsewhere[:, None]).any(axis=1)
            keep = (elsewhere == cell) | ~also | (cell < elsewhere)
            p, q = p[keep], q[keep]
            np.add.at(linked, p, copies[q])
            np.add.at(linked, q, copies[p])
            # One link to each group that a row meets and is not of; p is in order, so a row's pairs are a run.
            for i, near_i in zip(*_runs(p, q), strict=True):
                met, first = np.unique(group[near_i], return_index=True)
                new = met != group[i]
                if new.any():
                    out += [(node[i], node[j], 0) for j in near_i[first[new]]]
                    group[np.isin(group, met)] = group[i]
        out += [(node[k], None, linked[k]) for k in np.flatnonzero(linked)]
        found = pd.DataFrame(out, columns=["u", "v", "n"])
        return found.astype({"u": "int64", "v": "Int64", "n": "int64"})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, probes: int = 8, sample: int = SAMPLE) -> DataFrame:
    """vectors (vec_id, embedding, label, ...) to (vec_id, n_links, component_id, kept), a row per row.

    Vectors of one label and dimension are linked at cosine >= threshold;
    n_links counts the others linked directly, component_id is the smallest
    vec_id that links reach.  A pair whose homes lie outside each other's
    nearest ``probes`` cells is missed; up to that many cells nothing is.

    Defined cases: null, empty and zero vectors, such with null or non-finite
    components and those without label link with nothing.  Repeated rows link
    with each other; rows that share a vec_id share a component.  A row without
    vec_id counts as a link of others, has a null component and is kept.  Ties
    in nearness go to the smaller cell.  An empty table gives an empty result;
    further columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    doubles = F.col("embedding").cast("array<double>")
    sound = (
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists(doubles, lambda c: c != 0)
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.when(F.coalesce(sound, F.lit(False)), F.col("embedding")).alias("embedding"),
    )
    classes = cut(
        rows.where("embedding is not null")
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
        .select("label", F.size("embedding").alias("dim"), "embedding", "copies", F.coalesce("node", F.lit(2**62) + F.abs(F.xxhash64("label", "embedding") % 2**40)).alias("node"))
    )
    centres = spark.sparkContext.broadcast(_fit(classes, sample))
    kind = dict(classes.dtypes)["embedding"]
    placed = cut(
        classes.select("label", "dim", "node", "copies", "embedding").mapInPandas(
            _assign(centres, probes), f"label long, dim int, node long, copies long, embedding {kind}, near array<int>"
        )
    )
    in_cells = placed.withColumn("cell", F.explode("near")).withColumn("at_home", F.col("cell") == F.col("near")[0])
    # An aggregate is cut before its join, so that both sides are exchanges and a crowded key can be split.
    sizes = cut(
        placed.select("label", "dim", F.col("near")[0].alias("home"), F.explode("near").alias("cell"))
        .groupBy("label", "dim", "cell")
        .agg(F.count_if(F.col("home") == F.col("cell")).alias("homes"), F.count_if(F.col("home") != F.col("cell")).alias("guests"))
        .where("homes > 0")
        .select("label", "dim", "cell", F.ceil(F.col("homes") / CELL).cast("int").alias("blocks"), F.ceil(F.col("guests") / (4 * CELL)).cast("int").alias("chunks"))
    )
    # Home rows meet every block of the cell, guests the blocks of home rows alone.
    dealt = in_cells.join(sizes, ["label", "dim", "cell"]).withColumn(
        "block",
        F.when(F.col("at_home"), F.pmod(F.xxhash64("node"), F.col("blocks")))
        .otherwise(F.col("blocks") + F.pmod(F.xxhash64("node"), F.greatest("chunks", F.lit(1))))
        .cast("int"),
    )
    last = F.col("blocks") + F.when(F.col("at_home"), F.col("chunks")).otherwise(0) - 1
    paired = (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("left", F.least("block", "other"))
        .withColumn("right", F.greatest("block", "other"))
    )
    found = cut(paired.groupBy("label", "dim", "cell", "left", "right").applyInPandas(_products(threshold), "u long, v long, n long"))
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("linked"))
    shared = rows.where("vec_id is not null and embedding is not null").join(classes.select("label", "embedding", "node"), ["label", "embedding"])
    tied = shared.where("vec_id <> node").select("vec_id", "node").distinct()
    twice = tied.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1")
    own = shared.where("vec_id = node").select("vec_id").distinct()
    several = tied.join(twice, "vec_id", "left_semi").union(tied.join(own, "vec_id", "left_semi"))
    links = found.where("v is not null").select("u", "v").union(several.select(F.col("vec_id").alias("u"), F.col("node").alias("v")))
    groups = cut(
        classes.join(counts, "node", "left")
        .join(components(links), "node", "left")
        .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    named = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return rows.join(groups, ["label", "embedding"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        named.alias("component_id"),
        F.coalesce(named == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
