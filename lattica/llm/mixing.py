"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source's rate is its target share of the mixture over its share of the rows.
Each document draws a Poisson number of copies with that mean: its uniform
number comes from a seeded hash of its id, and the count is the number of
values whose cumulative probability it reaches.  Copies are then dealt over the
whole output by the hash of document and copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import cut, prepare

#: Sources, and bytes of their rates, that are broadcast; beyond either, documents are joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 20_000, 8 << 20
#: Digits of a hash that make a uniform number, and their range.
DIGITS, RANGE = 13, float(1 << 52)


def _digits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series at k + 10, less the ten factors."""
    n = k + 10
    series = n * F.ln(n) - n + 0.5 * F.ln(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)
    for step in range(1, 11):
        series = series - F.ln(k + step)
    return series


def rates(docs: DataFrame, group: str, weights: dict | None, alpha: float, total: int | None) -> DataFrame:
    """(mix_key, mix_rate) of each source: target share * total / rows."""
    counts = cut(docs.groupBy(F.col(group).alias("mix_key")).agg(F.count("*").alias("n")))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        known = docs.sparkSession.createDataFrame(list(weights.items()), f"k {dict(counts.dtypes)['mix_key']}, w double")
        weighed = counts.join(known, F.col("mix_key").eqNullSafe(F.col("k")), "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    sums = weighed.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    if not sums["n"] or not sums["w"]:
        return weighed.select("mix_key", F.lit(0.0).alias("mix_rate")).where("false")
    goal = float(sums["n"] if total is None else total)
    return weighed.select("mix_key", (F.col("w") / F.lit(float(sums["w"])) * F.lit(goal) / F.col("n")).alias("mix_rate"))


def _steps(rate: DataFrame) -> DataFrame:
    """Each source's cumulative probabilities from ``mix_low`` copies on, to beyond any 52-bit uniform number."""
    spread = 12 * F.sqrt("mix_rate")
    values = rate.where("mix_rate > 0").select(
        "mix_key",
        "mix_rate",
        F.explode(F.sequence(F.greatest(F.floor(F.col("mix_rate") - spread), F.lit(0)), F.ceil(F.col("mix_rate") + spread + 30))).alias("k"),
    )
    mass = F.exp(-F.col("mix_rate") + F.col("k") * F.ln("mix_rate") - _log_factorial(F.col("k").cast("double")))
    reached = F.sum("mass").over(Window.partitionBy("mix_key", "mix_rate").orderBy("k"))
    return (
        values.withColumn("mass", mass)
        .withColumn("reached", reached)
        .groupBy("mix_key")
        .agg(F.min("k").alias("mix_low"), F.sort_array(F.collect_list("reached")).alias("mix_steps"))
    )


def poisson_mix(
    docs: DataFrame,
    group: str = "source",
    weights: dict | None = None,
    alpha: float = 0.5,
    total: int | None = None,
    seed: int = 1,
) -> DataFrame:
    """docs (doc_id, text, source, ...) to the same columns and ``copy`` (from 1), in a global random order.

    weights gives each source's target weight (a source not named gets none);
    without it a source weighs as its row count to the power ``alpha``.  The
    mixture has ``total`` rows on average, by default as many as docs.

    Defined cases: a null source is a source; a null or empty text is a
    document like others; a row without doc_id draws by its text's hash;
    repeated rows draw the same number of copies each; an empty table, or
    weights of zero, give an empty result.  Other columns pass through, whatever
    their names, but a column ``copy`` gives way to the copies' numbers.
    """
    prepare(docs.sparkSession)
    steps = cut(_steps(rates(docs, group, weights, alpha, total)))
    sources, held = steps.agg(F.count("*"), F.sum(8 * F.size("mix_steps") + F.coalesce(F.octet_length(F.col("mix_key").cast("string")), F.lit(0)) + 32)).first()
    if sources <= BROADCAST_SOURCES and (held or 0) <= BROADCAST_BYTES:
        steps = F.broadcast(steps)
    # Names of one's own for the columns: none of theirs can clash with what is added here.
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    joined = docs.toDF(*names.values()).join(steps, F.col(names[group]).eqNullSafe(F.col("mix_key")))
    identity = F.coalesce(F.col(names["doc_id"]).cast("string"), F.md5(names["text"]), F.lit(""))
    uniform = _digits(F.concat(F.lit(f"{seed}:"), identity)) / F.lit(RANGE)
    count = (F.col("mix_low") + F.size(F.filter("mix_steps", lambda c: c <= F.col("mix_uniform")))).cast("int")
    kept = {c: n for c, n in names.items() if c != "copy"}
    drawn = joined.withColumn("mix_uniform", uniform).withColumn("mix_count", count).where("mix_count > 0")
    drawn = drawn.select(*kept.values(), identity.alias("mix_identity"), F.explode(F.sequence(F.lit(1), F.col("mix_count"))).alias("mix_copy"))
    place = _digits(F.concat_ws(":", F.lit(f"{seed}:place"), "mix_identity", F.col("mix_copy").cast("string")))
    dealt = drawn.withColumn("mix_place", place).repartition("mix_place").sortWithinPartitions("mix_place")
    return dealt.select(*kept.values(), "mix_copy").toDF(*kept, "copy")


#: The same rows in DuckDB: documents mixed by source with alpha 0.5 and seed 1.
ORACLE_SQL = """
with counts as (select source, count(*) n from documents group by source),
sums as (select sum(sqrt(n)) w, sum(n) n from counts),
rate as (select c.source, sqrt(c.n) / s.w * s.n / c.n as r from counts c, sums s),
steps as (
  select source, k, sum(exp(-r + k * ln(r) - lgamma(k + 1))) over (partition by source order by k) as reached
  from rate, unnest(range(greatest(floor(r - 12 * sqrt(r)), 0)::bigint, ceil(r + 12 * sqrt(r) + 30)::bigint + 1)) as t(k)
),
uniform as (
  select *, ('0x' || substr(md5('1:' || coalesce(doc_id::varchar, md5(text), '')), 1, 13))::bigint / 4503599627370496.0::double as u
  from documents
),
drawn as (
  select u.doc_id, u.text, u.lang, u.source, u.n_chars,
         (min(s.k) + count(*) filter (where s.reached <= u.u))::int as copies
  from uniform u join steps s on u.source is not distinct from s.source
  group by all
)
select doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::int as copy from drawn
"""
