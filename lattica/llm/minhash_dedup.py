"""Near-duplicate documents by MinHash, banding and verification on full sets.

A document's set holds its distinct shingles of five words (lower-cased A-Z,
words between ASCII white space).  156 universal hash minima make bands of as
many rows, six at most, as let a pair at the threshold share no band with a
chance of 1e-5 at most: 26 bands of six at 0.85 (5e-6), 31 of five at 0.80 (5e-6).

Equal sets are one class from the start.  In each band's bucket every class is
compared with one leader only, the class whose buckets hold most others: first
by signature, then on the full sets.  Where these links leave several components
in a bucket, its classes are compared in blocks, all pairs across components,
again by signature and then on the full sets.  So no pair that shares a band
stays uncompared unless links join it anyway, a group of copies costs a row per
member, and pairs never become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, drop, finish, hashed, in_blocks, known, rolled, through
from lattica.llm.components import components

WORDS = 5
HASHES, ROWS = 156, 6
#: The largest chance that a pair at the threshold shares no band.
MISSED = 1e-5
#: Signature similarity below which a pair is not verified: 0.15 (5 deviations at 0.85, 4.7 at 0.80) under the threshold.
SLACK = 0.15
#: Classes, and bytes of their sets, in a block of the comparison of what stayed apart (on average: blocks are dealt by hash).
BLOCK, BLOCK_SETS = 1024, 16 << 20

_SEED = np.random.default_rng(20240601)
_A = _SEED.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 2**63, HASHES, dtype=np.uint64)
_C = _SEED.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; empty without words."""
    for begin, end in in_blocks(texts):
        split = [t.lower().split() for t in texts[begin:end]]
        hashes, at = hashed([w for words in split for w in words]), 0
        for words in split:
            own = hashes[at : at + len(words)]
            at += len(words)
            yield np.unique(rolled(own, min(WORDS, len(words)))) if words else np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash a*x + b over the set."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        part = _A[:, None] * shingles[None, k : k + 2048]
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_rows(percent: int) -> int:
    """The most rows of a band, ROWS at most, with which a pair at the threshold is missed no more often than MISSED."""
    fitting = (r for r in range(ROWS, 0, -1) if (1 - (percent / 100) ** r) ** (HASHES // r) <= MISSED)
    return next(fitting, 1)


def _set_key(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def _features(size: int):
    """Set size, set key, signature and the hashes of its bands of ``size`` rows."""
    count = HASHES // size

    def step(texts: list) -> dict:
        out = {"n_shingles": [], "set_key": [], "signature": [], "bands": []}
        for shingles in shingle_sets(known(texts)):
            packed = len(shingles) > 0
            least = signature(shingles)
            banded = least[: count * size].reshape(count, size) * _C[:size]
            bands = finish(banded.sum(axis=1, dtype=np.uint64) + np.arange(count, dtype=np.uint64))
            out["n_shingles"].append(len(shingles))
            out["set_key"].append(_set_key(shingles.tobytes()) if packed else None)
            out["signature"].append((least >> np.uint64(48)).astype("<u2").tobytes() if packed else None)
            out["bands"].append(bands.view(np.int64) if packed else None)
        return out

    return lambda: step


_FEATURES = "n_shingles long, set_key binary, signature binary, bands array<long>"


def _agreeing(slack: float):
    """Keeps pairs whose signatures and set sizes allow the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [
                float(np.mean(np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2"))) >= slack
                for a, b in zip(batch["u_signature"], batch["v_signature"], strict=True)
            ]
            yield batch.loc[keep, ["u", "v"]]

    return run


def _linked(percent: int):
    """Keeps pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["u_set"], batch["v_set"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[keep, ["u", "v"]]

    return run


def _sets(texts: list) -> dict:
    packed = [s.tobytes() for s in shingle_sets(known(texts))]
    return {"set_key": [_set_key(s) for s in packed], "shingles": packed}


def _pairs(rows: pd.DataFrame, percent: int, left: int, right: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's possible partners in other components: by set size, signature, and as the first bucket of both.

    A pair that shares several buckets is left to the first of them: there it is
    compared, or was, as one of the two leads that bucket.
    """
    least = percent / 100 - SLACK
    marks = np.frombuffer(b"".join(rows["signature"]), "<u2").reshape(len(rows), -1)
    bands = np.stack([np.asarray(b, np.int64) for b in rows["bands"]])
    at = int(np.flatnonzero(bands[0] == rows["bucket"].iloc[0])[0])
    sizes, component, block = rows["n_shingles"].to_numpy(), rows["component"].to_numpy(), rows["block"].to_numpy()
    mine, theirs = np.flatnonzero(block == left), np.flatnonzero(block == right)
    if len(mine) > len(theirs):
        mine, theirs = theirs, mine
    for k in mine:
        others = theirs[theirs > k] if left == right else theirs
        others = others[(component[others] != component[k]) & (100 * np.minimum(sizes[others], sizes[k]) >= percent * np.maximum(sizes[others], sizes[k]))]
        others = others[(marks[others] == marks[k]).mean(axis=1) >= least] if len(others) else others
        others = others[~(bands[others, :at] == bands[k, :at]).any(axis=1)] if len(others) else others
        if len(others):
            yield k, others


def _possible(percent: int):
    """The rows of two blocks of a bucket that have a possible partner."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, found = rows.reset_index(drop=True), set()
        for k, others in _pairs(rows, percent, key[1], key[2]):
            found.update([k], others)
        return rows.loc[sorted(found), ["bucket", "left", "right", "block", "node", "component"]]

    return run


def _across(percent: int):
    """Links between different components among the rows of two blocks, found on full sets: a spanning set of them.

    Intersections of one set with others are counted over a shared numbering of
    the rows' shingles, so nothing is estimated.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        names, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        parent = {c: c for c in rows["component"]}

        def top(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        component, found = rows["component"].to_numpy(), []
        mark = np.zeros(len(names), np.int64)
        for k, others in _pairs(rows, percent, key[1], key[2]):
            mine = numbers[ends[k] - sizes[k] : ends[k]]
            mark[mine] = 1
            for j in others:
                a, b = top(component[k]), top(component[j])
                if a != b:
                    common = int(mark[numbers[ends[j] - sizes[j] : ends[j]]].sum())
                    if 100 * common >= percent * (sizes[k] + sizes[j] - common):
                        parent[a] = b
                        found.append((component[k], component[j]))
            mark[mine] = 0
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, row: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, n_shingles, component_id, kept), a row per row.

    Documents with 100 * intersection >= percent * union of their shingle sets
    are linked; component_id is the smallest doc_id that links reach.

    Defined cases: a null, empty or blank text has an empty set and links with
    nothing.  Rows that share a doc_id share a component, and each is kept if
    the doc_id is the smallest.  A row without doc_id has a null component and
    is kept.  Ties have no effect: links and minima don't depend on order.  An
    empty table gives an empty result; further columns are ignored.

    With ``row``, the name of a string column that tells rows apart, each row is
    a document by itself, also one without doc_id or one that shares it: of each
    component that with the smallest doc_id, then the smallest ``row``, is kept
    (rows without doc_id come last), and the column follows the others.  Rows
    that share ``row`` too are kept together.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(row) if row else F.lit("")).alias("own")
    )
    features = cut(through(docs, _FEATURES, _features(band_rows(percent))))
    counted = features.where("n_shingles > 0" if row else "doc_id is not null and n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "own")
    classes = cut(
        counted.groupBy("set_key")
        .agg(
            F.min(first).alias("first"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        )
        # A number of the class's own: classes whose smallest doc_id is the same stay apart.
        .withColumn("node", F.monotonically_increasing_id())
    )
    banded = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    # An aggregate is cut before its join, so that both sides are exchanges and a crowded key can be split.
    several = cut(banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
    crowded = cut(banded.join(several, "bucket"))
    drop(several)
    central = cut(crowded.groupBy("node").agg(F.sum("members").alias("weight")))
    leaders = cut(
        crowded.join(central, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
        .select("bucket", (-F.col("top.minus")).alias("leader"))
    )
    starred = cut(crowded.join(leaders, "bucket").where("node <> leader").select("bucket", "node", "n_shingles", "leader", "members"))
    candidates = starred.select(F.greatest("node", "leader").alias("u"), F.least("node", "leader").alias("v")).distinct()
    for done in (crowded, leaders):
        drop(done)
    marks = classes.select("node", "n_shingles", "signature")
    close = (
        candidates.join(marks.select(F.col("node").alias("u"), F.col("n_shingles").alias("u_n"), F.col("signature").alias("u_signature")), "u")
        .join(marks.select(F.col("node").alias("v"), F.col("n_shingles").alias("v_n"), F.col("signature").alias("v_signature")), "v")
        .where(100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n"))
        .mapInPandas(_agreeing(percent / 100 - SLACK), "u long, v long")
    )
    sets = _sets_of(docs, central.join(classes.select("node", "first", "set_key"), "node"))
    verified = (
        close.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("u_set")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("v_set")), "v")
        .mapInPandas(_linked(percent), "u long, v long")
    )
    links = verified if row else verified.union(_tied(features, classes))
    near = cut(components(links))
    apart = _apart(starred.where("members > 2"), near, classes, sets, percent)
    for done in (starred, central, sets):
        drop(done)
    near = classes.select("node", "set_key", "first").join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if apart.limit(1).count():
        merged = cut(components(apart)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        near = near.join(merged, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    near = cut(near.select("set_key", "component", "first"))
    least = cut(near.groupBy("component").agg(F.min("first").alias("least")))
    placed = cut(near.join(least, "component").select("set_key", "least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
    kept = F.coalesce(F.col("least") == first, F.lit(True)) if row else F.coalesce(component == F.col("doc_id"), F.lit(True))
    found = features.join(placed, "set_key", "left")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *([F.col("own").alias(row)] if row else []))


def _tied(features: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id: they are one document, whatever their texts."""
    known = features.where("doc_id is not null and n_shingles > 0").select("doc_id", "set_key")
    shared = cut(known.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b").select("doc_id"))
    if not shared.limit(1).count():
        return shared.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v"))
    several = cut(known.join(shared, "doc_id").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node").distinct())
    return several.join(cut(several.groupBy("doc_id").agg(F.min("node").alias("u"))), "doc_id").select("u", F.col("node").alias("v"))


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the full sets of the wanted classes (node, first, set_key), from one text of each."""
    wanted = cut(wanted.select("node", "set_key", "first.doc_id", "first.own"))
    one = docs.join(wanted.select("doc_id", "own"), docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["own"] == wanted["own"]), "left_semi")
    sets = through(one.select("text"), "set_key binary, shingles binary", lambda: _sets, kept=[]).dropDuplicates(["set_key"])
    return cut(sets.join(wanted, "set_key").select("node", "shingles"))


def _apart(starred: DataFrame, near: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v: components) that verified links leave out, from the buckets that several components share.

    Leaders are not among a bucket's rows here, as they were compared with all of them.

    A bucket's rows go to blocks of bounded rows and bytes of sets.  Rows of its
    largest component meet the other rows only, so a group of copies costs a
    row a member and block of others.  Signatures tell which rows have a
    possible partner; the full sets of those alone are compared.
    """
    placed = cut(starred.join(near, "node", "left").select("bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component")))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    blocks = lambda n, m: F.ceil(F.greatest(F.col(n) / BLOCK, 8 * F.col(m) / BLOCK_SETS)).cast("int")
    mixed = cut(
        parts.groupBy("bucket")
        .agg(F.count("*").alias("parts"), F.max(F.struct("n", "component", "m")).alias("top"), F.sum("n").alias("n"), F.sum("m").alias("m"))
        .where("parts > 1")
        .select("bucket", F.col("top.component").alias("main"), "top.n", "top.m", (F.col("n") - F.col("top.n")).alias("rest"), (F.col("m") - F.col("top.m")).alias("rest_m"))
        .select("bucket", "main", blocks("n", "m").alias("home"), blocks("rest", "rest_m").alias("away"))
    )
    dealt = placed.join(mixed, "bucket").withColumn(
        "block",
        F.when(F.col("component") == F.col("main"), F.pmod(F.xxhash64("node"), F.col("home")))
        .otherwise(F.col("home") + F.pmod(F.xxhash64("node"), F.col("away")))
        .cast("int"),
    )
    start = F.when(F.col("component") == F.col("main"), F.col("home")).otherwise(0)
    marks = classes.select("node", "signature", "bands")
    paired = (
        dealt.withColumn("other", F.explode(F.sequence(start, F.col("home") + F.col("away") - 1)))
        .select("bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "n_shingles", "component")
    )
    possible = cut(paired.join(marks, "node").groupBy("bucket", "left", "right").applyInPandas(_possible(percent), "bucket long, left int, right int, block int, node long, component long"))
    drop(placed)
    drop(mixed)
    full = possible.join(sets, "node").join(classes.select("node", "n_shingles", "signature", "bands"), "node")
    return cut(full.groupBy("bucket", "left", "right").applyInPandas(_across(percent), "u long, v long"))
