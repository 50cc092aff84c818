"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of bytes other than ASCII non-alphanumerics, with A-Z lower-cased.
An item's windows are its runs of ten words; a shorter item is one window.
Training texts are scanned window by window against the sorted hashes, and each
hit is verified on the words themselves.  The set is broadcast in parts of a
bounded number of windows, each part scanning the corpus once, so a benchmark
of any size fits the executors; a usual one is a single part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, drop, hashed, in_blocks, known, prepare, rolled, through

WINDOW = 10
#: Windows in one broadcast part: about 400 bytes each in a worker, so 80 MB at most.
PART_WINDOWS = 200_000

#: Bytes that are no part of a word become blanks; upper-case letters become lower-case.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _item_windows(size: int):
    def step(texts: list) -> dict:
        out = []
        for text in known(texts):
            words = words_of(text)
            n = min(size, len(words))
            runs = {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)} if n else ()
            out.append([{"size": n, "words": w} for w in sorted(runs)])
        return {"windows": out}

    return lambda: step


class Windows:
    """Windows by size: sorted hashes to search, and the words with their items to verify."""

    def __init__(self, rows: list[tuple[int, bytes, list[str]]]):
        self.items = {words: items for _, words, items in rows}
        self.hashes = {}
        for size in sorted({size for size, _, _ in rows}):
            flat = [w for n, words, _ in rows if n == size for w in words.split(b" ")]
            own = hashed(flat).reshape(-1, size)
            self.hashes[size] = np.unique(np.concatenate([rolled(h, size) for h in own]))

    def hits(self, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Marks of the words inside occurring windows, and the items of those windows."""
        inside, items = np.zeros(len(words) + 1, np.int64), set()
        for size, known in self.hashes.items():
            own = rolled(hashes, size)
            if not len(own):
                continue
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            for k in np.flatnonzero(known[at] == own):
                found = self.items.get(b" ".join(words[k : k + size]))
                if found is not None:
                    items.update(found)
                    inside[k] += 1
                    inside[k + size] -= 1
        return np.cumsum(inside[:-1]) > 0, items


def _scan(shared):
    """Number of words, marks of hit words as packed bits, their number, and the items."""

    def step(texts: list) -> dict:
        windows: Windows = shared.value
        out = {"n_words": [], "n_hit": [], "marks": [], "items": []}
        texts = known(texts)
        for begin, end in in_blocks(texts):
            split = [words_of(t) for t in texts[begin:end]]
            hashes, at = hashed([w for words in split for w in words]), 0
            for words in split:
                inside, found = windows.hits(words, hashes[at : at + len(words)])
                at += len(words)
                out["n_words"].append(len(words))
                out["n_hit"].append(int(inside.sum()))
                out["marks"].append(np.packbits(inside).tobytes() if inside.any() else None)
                out["items"].append(sorted(found))
        return out

    return lambda: step


def _joined(marks: list[bytes | None] | None) -> bytes | None:
    """The marks of several parts together."""
    own = [np.frombuffer(m, np.uint8) for m in marks or () if m is not None]
    return np.bitwise_or.reduce(own).tobytes() if own else None


def _counted(rows: list) -> dict:
    return {"n_hit": [int(np.unpackbits(np.frombuffer(m, np.uint8)).sum()) if (m := _joined(r)) else 0 for r in rows]}


def _without(rows: list) -> dict:
    """Texts without their hit words; the rest, punctuation included, stays as it is."""
    texts = []
    for row in rows:
        marks = _joined(row["marks"])
        if marks is None:
            texts.append(row["text"])
            continue
        raw = row["text"].encode("utf-8", "surrogatepass")
        folded, at, kept, done = raw.translate(_FOLD), 0, [], 0
        for word, hit in zip(folded.split(), np.unpackbits(np.frombuffer(marks, np.uint8)), strict=False):
            at = folded.index(word, at)
            if hit:
                kept.append(raw[done:at])
                done = at + len(word)
            at += len(word)
        texts.append(b"".join([*kept, raw[done:]]).decode("utf-8", "surrogatepass"))
    return {"text": texts}


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """benchmark (item_id, text, ...) to its distinct windows (size, words, items as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = through(items.where("item_id is not null"), "windows array<struct<size: int, words: binary>>", _item_windows(size)).select("item_id", F.explode("windows").alias("w"))
    return rows.groupBy("w.size", "w.words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _parts(windows: DataFrame, most: int) -> Iterator[Windows]:
    windows = cut(windows)
    parts = max(1, -(-windows.count() // most))
    for k in range(parts):
        part = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == k)
        yield Windows([(r["size"], bytes(r["words"]), r["items"]) for r in part.toLocalIterator()])


def scanned(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = PART_WINDOWS) -> DataFrame:
    """docs, each row with a further column ``lattica``: (n_words, n_hit, marks: one of each part, items).

    Each part is one narrow pass over the rows as they come; with several parts
    a pass's rows are cut before the next, so a task holds one part at a time.
    """
    spark = docs.sparkSession
    prepare(spark)
    names, before = [f"c{k}" for k in range(len(docs.columns))], None
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]).cast("string"))
    none = "cast(array() as array<string>)"
    frame = plain.withColumn("so_far", F.expr(f"struct(0L as n_words, 0L as n_hit, cast(array() as array<binary>) as marks, {none} as items)"))
    for k, windows in enumerate(_parts(item_windows(benchmark, size), most)):
        if k:
            frame = cut(frame)
            if before is not None:
                drop(before)
            before = frame
        made = through(frame, "n_words long, n_hit long, marks binary, items array<string>", _scan(spark.sparkContext.broadcast(windows)), kept=[*names, "text", "so_far"])
        marks = F.when(F.col("marks").isNull(), F.col("so_far.marks")).otherwise(F.array_append("so_far.marks", F.col("marks")))
        items = F.array_sort(F.array_distinct(F.concat("so_far.items", "items")))
        frame = made.select(*names, "text", F.struct("n_words", "n_hit", marks.alias("marks"), items.alias("items")).alias("so_far"))
    if before is not None:
        frame = through(frame.withColumn("marks", F.col("so_far.marks")), "n_hit long", lambda: _counted, column="marks", kept=[*names, "so_far"])
        frame = frame.withColumn("so_far", F.col("so_far").withField("n_hit", F.col("n_hit")))
    return frame.select(*names, "so_far").toDF(*docs.columns, "lattica")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = PART_WINDOWS) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    Defined cases: null and empty texts have no words and no hits; items
    without words or without item_id have no windows; equal windows of several
    items count for each; an empty benchmark hits nothing and an empty table
    gives an empty result.  Rows are kept as they come, repeated ones and those
    without doc_id included; further columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scanned(narrow, benchmark, size, most).select(
        "doc_id",
        "lattica.n_words",
        "lattica.n_hit",
        F.size("lattica.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("lattica.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("lattica.n_hit") > 0).alias("contaminated"),
    )


def without_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = PART_WINDOWS) -> DataFrame:
    """The same rows and columns with the hit words cut out of each text; other columns stay as they are.

    The marks of all parts are joined before anything is cut, so the result
    doesn't depend on the parts' size.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    found = scanned(docs, benchmark, size, most).toDF(*names, "lattica")
    rows = found.select(*names, F.struct(F.col(text).cast("string").alias("text"), F.col("lattica.marks").alias("marks")).alias("row"))
    done = through(rows, "text string", lambda: _without, column="row", kept=[n for n in names if n != text])
    return done.select(*["text" if n == text else n for n in names]).toDF(*docs.columns)
