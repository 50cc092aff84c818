"""Quality classifier: hashed word n-grams, logistic regression by FTRL, sparse dot products.

Tokens are words and runs of punctuation, case kept.  A text's features are its
tokens, pairs of neighbouring tokens, and repeats of a token within the last
few, each hashed; a feature's value is the root of its count, and a text's
values have length 1.  The model is fitted on a bounded sample of labelled rows
and broadcast: 2**BITS weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import crc_bucket, finish, hashed, in_blocks, known, rolled, through
from lattica.llm.ftrl import Ftrl, sigmoid, summed

BITS = 18
#: Labelled rows that the model is fitted on at most.
SAMPLE = 4096
#: Bytes of feature indices of those rows that the driver holds at most.
FIT_BYTES = 128 << 20
EPOCHS = 6
LAGS = 8
#: Documents score this or more to be kept.
KEEP = 0.3

_MARKS = re.compile(rb"([!-/:-@\[-`{-~]+)")


def tokens(text: bytes) -> list[bytes]:
    return _MARKS.sub(rb" \1 ", text).split()


def _vectors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's feature indices and values; index 0 is the bias."""
    for begin, end in in_blocks(texts):
        split = [tokens(t) for t in texts[begin:end]]
        hashes, done = hashed([w for words in split for w in words]), 0
        for words in split:
            own = hashes[done : done + len(words)]
            done += len(words)
            parts = [finish(own), rolled(own, 2)]
            for lag in range(1, LAGS + 1):
                parts.append(np.full(int((own[lag:] == own[:-lag]).sum()), lag, np.uint64))
            at, counts = summed(np.concatenate(parts) % np.uint64((1 << BITS) - 1) + np.uint64(1))
            x = np.sqrt(counts)
            x = x / max(float(np.sqrt((x * x).sum())), 1e-9)
            yield np.concatenate([[0], at.astype(np.int64)]), np.concatenate([[1.0], x])


def _packed(texts: list) -> dict:
    rows = [(at.astype("<i4").tobytes(), x.astype("<f4").tobytes()) for at, x in _vectors(known(texts))]
    return {"at": [at for at, _ in rows], "x": [x for _, x in rows]}


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, label, text) of at most ``most`` labelled ids that aren't held out: those with the smallest hashes.

    Rows that share a doc_id are one example, with the smallest of their texts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_bucket() != 0))
    chosen = rows.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "label").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most ``most`` ids go to each executor.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def bounded(rows: DataFrame, key: str, size: str, most: int) -> list:
    """Rows of at most ``most`` bytes together (those with the smallest hashes of ``key``), sorted by it."""
    found, held = [], 0
    for r in rows.orderBy(F.xxhash64(key), key).toLocalIterator():
        held += len(r[size])
        if held > most:
            break
        found.append(r)
    return found


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, most: int = FIT_BYTES) -> np.ndarray | None:
    """Weights fitted on the labelled rows of docs that aren't held out; None without rows of both labels."""
    rows = through(labelled_sample(docs, labels, "quality", sample), "at binary, x binary", lambda: _packed, kept=["label"])
    found = sorted((bytes(r["at"]), bytes(r["x"]), r["label"]) for r in bounded(rows, "at", "at", most))
    y = [label for _, _, label in found]
    if len(set(y)) < 2:
        return None
    vectors = [(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4").astype(float)) for a, x, _ in found]
    return Ftrl(BITS, alpha=0.5, l1=0.02, l2=0.1).fit(vectors, y, epochs).weights().astype(np.float32)


def score(texts: list[bytes], weights: np.ndarray | None) -> list[float]:
    """Probabilities of label 1 by sparse dot products."""
    if weights is None:
        return [1.0] * len(texts)
    return [float(sigmoid(float(weights[at] @ x))) for at, x in _vectors(texts)]


def with_quality(docs: DataFrame, labels: DataFrame, name: str, sample: int = SAMPLE) -> DataFrame:
    """docs and the score of each row's own text in a further column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    work = lambda: lambda texts: {name: score(known(texts), shared.value)}
    return through(docs.withColumn("text", F.col("text").cast("string")), f"`{name}` double", work, kept=docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text, ...) and labels (doc_id, quality, ...) to (doc_id, held_out, score, predicted), a row per row.

    Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0.

    Defined cases: null, empty and blank texts have the bias alone and so one
    score; labels that are null or neither 0 nor 1, and ids without a text, are
    no examples; rows that share a doc_id are one example; without examples of
    both labels every score is 1.
    A row without doc_id is scored, and held out is false.  An empty table
    gives an empty result; further columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_quality(narrow, labels, "score", sample).select(
        "doc_id",
        F.coalesce(crc_bucket() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
