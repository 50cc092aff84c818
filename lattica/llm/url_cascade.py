"""URL rules by Bloom filter cascades.

Odd levels of a cascade encode listed keys, even levels the unlisted keys of
the corpus that the level before takes for listed.  Over the corpus's complete
key universe the first level that rejects a key tells exactly whether it is
listed, so urls are judged by hashing alone, without a join.

A url's keys are the ends of its host, joined to the starts of its path whose
lengths some rule has; the longest listed key is its rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import cut, prepare

#: Bits of a level: 32 MB, so its broadcast is bounded.  Longer lists are dealt over several cascades.
MOST_BITS = 1 << 28
MOST_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashes_of(listed_keys: int, others: int, first: bool) -> int:
    """Hash functions of a level: for a false positive rate of a half, or lower at the first level where lists are short."""
    rate = min(0.5, listed_keys * math.sqrt(0.5) / max(others, 1)) if first else 0.5
    return max(1, math.ceil(-math.log2(rate)))


def shards_of(listed_keys: int, others: int) -> int:
    """Cascades that a list is dealt over by hash, so that no level has more than MOST_BITS."""
    bits = max(listed_keys * hashes_of(listed_keys, others, True), others) / math.log(2)
    return max(1, math.ceil(bits / (0.9 * MOST_BITS)))


class Level:
    """One Bloom filter over pairs of 64-bit hashes, eight bits a byte."""

    def __init__(self, keys: int, hashes: int, salt: int):
        self.hashes = hashes
        self.size = max(64, math.ceil(keys * hashes / math.log(2)))
        self.salt = salt
        self.bits = np.zeros(-(-self.size // 8), np.uint8)

    def at(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The positions of each key: a row for each."""
        step = (h2 | np.uint64(1))[:, None] * np.arange(1, self.hashes + 1, dtype=np.uint64)[None, :]
        x = (h1[:, None] ^ np.uint64(self.salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) + step
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(16)) % np.uint64(self.size)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.at(h1, h2)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def set(self, words: np.ndarray, masks: np.ndarray) -> None:
        """Sets the bits of 32-bit words, each given once."""
        packed = np.zeros(-(-self.size // 32), "<u4")
        packed[words] = masks
        self.bits |= packed.view(np.uint8)[: len(self.bits)]


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed."""
    left, found = np.arange(len(h1)), np.zeros(len(h1), bool)
    for depth, level in enumerate(levels):
        inside = level.has(h1[left], h2[left])
        found[left[~inside]] = depth % 2 == 1
        left = left[inside]
    found[left] = len(levels) % 2 == 1
    return found


def _inserted(levels, wanted: int):
    """The keys that reach the next level, as positions in it aren't known before they are counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch[batch["listed"] == wanted]
            h1, h2 = own["h1"].to_numpy().view(np.uint64), own["h2"].to_numpy().view(np.uint64)
            keep = np.ones(len(own), bool)
            for level in levels.value:
                keep &= level.has(h1, h2)
            yield own.loc[keep, ["h1", "h2"]]

    return run


def _words(empty: Level):
    """The bits that a partition's keys set, as (word, mask) pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(empty.at(batch["h1"].to_numpy().view(np.uint64), batch["h2"].to_numpy().view(np.uint64)))
            yield pd.DataFrame({"word": (at // np.uint64(32)).astype(np.int64), "mask": np.int64(1) << (at % np.uint64(32)).astype(np.int64)})

    return run


def build(universe: DataFrame) -> list[Level]:
    """The cascade of a universe (key, listed: 0 or 1) of distinct keys.

    Ends when a level has nothing to encode; two hashes of 64 bits tell keys
    apart.  What reaches the driver is a level's bits, which MOST_BITS bounds
    where the universe is one shard of shards_of().
    """
    spark = universe.sparkSession
    keys = cut(universe.select("listed", *_hashes("key")))
    counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    levels: list[Level] = []
    waiting = counts.get(1, 0)
    while waiting:
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("the cascade does not end: keys with equal hashes")
        level = Level(waiting, hashes_of(waiting, counts.get(0, 0), not levels), len(levels) + 1)
        own = keys.mapInPandas(_inserted(spark.sparkContext.broadcast(levels), 1 - len(levels) % 2), "h1 long, h2 long")
        words = own.mapInPandas(_words(level), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
        level.set(words["word"].to_numpy(np.int64), words["mask"].to_numpy(np.int64))
        levels.append(level)
        wanted = 1 - len(levels) % 2
        waiting = keys.mapInPandas(_inserted(spark.sparkContext.broadcast(levels), wanted), "h1 long, h2 long").count()
    return levels


def _hashes(key: str | Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def _keys(rules: list[tuple[str, str]]) -> Column:
    """A url's keys, longest first, of equal lengths that with the longer host first."""
    labels = sorted({host.count(".") + 1 for host, _ in rules}, reverse=True)
    lengths = sorted({len(path) for _, path in rules}, reverse=True)
    ends = F.array(*[
        F.when(F.size("labels") >= n, F.array_join(F.slice("labels", F.size("labels") - n + 1, F.lit(n)), ".")) for n in labels
    ])
    pairs = F.flatten(F.array(*[
        F.transform(
            F.filter(ends, lambda e: e.isNotNull() & (F.length("path") >= n)),
            lambda e: F.struct((-F.length(e) - n).alias("order"), (-F.length(e)).alias("host"), F.concat(e, F.substring("path", 1, n)).alias("key")),
        )
        for n in lengths
    ]))
    return F.transform(F.array_sort(pairs), lambda p: p["key"])


def _flags(allowed, blocked, shard: int, shards: int):
    """For each key of a url whether it is in a list: 1 allowed, 2 blocked, 3 both; 0 also for keys of other shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hashes")
            flat = hashes.flatten()
            h1, h2 = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (0, 1))
            found = listed(allowed.value, h1, h2).astype(np.int8) | listed(blocked.value, h1, h2).astype(np.int8) << 1
            found[h1 % np.uint64(shards) != shard] = 0
            sizes = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flags = pa.ListArray.from_arrays(pa.array(ends), pa.array(found))
            out = [batch.column(c) if c != "hashes" else hashes for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*out, flags], names=[*batch.schema.names, "found"])

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages (page_id, url, ...) by rules (verdict, host, path): (page_id, host, path, rule, verdict), a row per row.

    A rule fits its host and subdomains of it, where the url's path starts with
    the rule's; the longest wins, of equal lengths that with the longer host.
    A url that no rule fits is on no list, so it is allowed.

    Defined cases: a null url, or one without ://, has empty host and path and
    fits no rule; very long urls are judged whole; repeated rows and rows
    without page_id are judged like others; a rule in both lists blocks; an
    empty table gives an empty result and no rules allow all.  Further columns
    are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    keys = [(verdict, host, path) for verdict, host, path in rules]
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not keys:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keyed = split.withColumn("labels", F.split("host", "\\.")).withColumn("keys", _keys([(h, p) for _, h, p in keys])).drop("labels")
    corpus = keyed.select(F.explode("keys").alias("key"))
    lists = spark.createDataFrame([(h + p, v) for v, h, p in keys], "key string, verdict string")
    universe = cut(
        corpus.withColumn("verdict", F.lit(""))
        .union(lists)
        .groupBy("key")
        .agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"), F.max((F.col("verdict") == "block").cast("int")).alias("blocked"))
    )
    counts = universe.agg(F.count("*"), F.sum("allowed"), F.sum("blocked")).first()
    shards = max(shards_of(own or 0, counts[0] - (own or 0)) for own in counts[1:])
    share = spark.sparkContext.broadcast
    ready = keyed.withColumns({"hashes": F.transform("keys", lambda k: F.struct(*_hashes(k))), "flags": F.transform("keys", lambda _: F.lit(0).cast("byte"))})
    for shard in range(shards):
        # A pass over the urls for each shard; a usual list is one.
        part = universe if shards == 1 else universe.where(_shard(F.xxhash64("key"), shards) == shard)
        allowed, blocked = (share(build(part.select("key", F.col(c).alias("listed")))) for c in ("allowed", "blocked"))
        fields = T.StructType([*ready.schema.fields, T.StructField("found", T.ArrayType(T.ByteType()))])
        marked = ready.mapInArrow(_flags(allowed, blocked, shard, shards), fields)
        ready = marked.withColumn("flags", F.zip_with("flags", "found", lambda a, b: F.greatest(a, b))).drop("found")
    hits = F.filter(F.arrays_zip("keys", "flags"), lambda k: k["flags"] > 0)
    first = F.get(hits, F.lit(0))
    verdict = F.when(first["flags"] >= 2, "block").otherwise("allow")
    return ready.select("page_id", "host", "path", first["keys"].alias("rule"), verdict.alias("verdict"))


def _shard(h1: Column, shards: int) -> Column:
    """h1 as an unsigned number, modulo the shards."""
    return F.pmod(F.pmod(h1, F.lit(shards)) + F.when(h1 < 0, F.lit((1 << 64) % shards)).otherwise(F.lit(0)), F.lit(shards))


#: The rules of the registered query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: The registered query in DuckDB.
ORACLE_SQL = """
with rules(verdict, host, path) as (values
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') as path from rest),
fitting as (
  select s.page_id, s.host, s.path, r.host || r.path as rule, r.verdict,
         row_number() over (partition by s.page_id order by length(r.host || r.path) desc, length(r.host) desc) as k
  from split s left join rules r
    on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fitting where k = 1
"""
