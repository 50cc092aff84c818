"""Catalogue of the engine's registered queries, each beside the SQL that DuckDB answers it with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.dataset import Dataset
from lattica.functions import scalar
from lattica.operators import aggregates as A
from lattica.operators import decompose, partition, relational
from lattica.session import Context, shared_folder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _set(spark: SparkSession, sf: str, name: str, *order: str) -> Dataset:
    return Dataset(_table(spark, sf, name), order)


def _events(spark: SparkSession, sf: str) -> Dataset:
    return _set(spark, sf, "events", "event_id")


def _cents(column: str = "value"):
    return F.round(F.col(column) * 100).cast("long")


# ---- words ----


@query("select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) group by word")
def word_count(spark, sf):
    words = _set(spark, sf, "documents").select("text").select_many(scalar.split_on(F.col("text"), " "), "word", [])
    return words.group_by("word", aggregates={"n": F.count("*")}).frame


@query(
    "select word, count(*) as n, word || ': ' || count(*) as line from "
    "(select unnest(string_split(text, ' ')) as word from documents) group by word order by n desc, word limit 20"
)
def word_topk(spark, sf):
    counts = Dataset(word_count(spark, sf)).order_by(F.desc("n"), F.asc("word")).take(20)
    return counts.select("word", "n", scalar.format_pair("{0}: {1}", F.col("word"), F.col("n")).alias("line")).frame


@query("select substr(word, 1, 1) as key, count(*) as n, count(distinct word) as words from (select unnest(string_split(text, ' ')) as word from documents) where word <> '' group by 1")
def map_reduce_initials(spark, sf):
    items = F.filter(scalar.split_on(F.col("text"), " "), lambda w: w != "")
    return _set(spark, sf, "documents").map_reduce(items, lambda w: F.substring(w, 1, 1), {"n": F.count("*"), "words": F.count_distinct("item")}).frame


@query("select lang, count(*) as n_words from (select lang, unnest(string_split(text, ' ')) as word from documents) group by lang")
def map_reduce_lang(spark, sf):
    return _set(spark, sf, "documents").select_many(scalar.split_on(F.col("text"), " "), "word", ["lang"]).group_by("lang", aggregates={"n_words": F.count("*")}).frame


@query("select doc_id, word, length(word)::int as size from (select doc_id, unnest(string_split(text, ' ')) as word from documents)")
def select_many_props(spark, sf):
    return _set(spark, sf, "documents").select_many(scalar.split_on(F.col("text"), " "), "word", ["doc_id"]).select("doc_id", "word", F.length("word").alias("size")).frame


@query("select doc_id, word, length(word)::int as size from (select doc_id, unnest(string_split(text, ' ')) as word from documents)")
def select_many_words(spark, sf):
    words = _set(spark, sf, "documents").select_many(scalar.split_on(F.col("text"), " "), "word", ["doc_id"])
    return words.select("doc_id", "word", F.length("word").alias("size")).frame


@query("select doc_id, length(text)::int as size from documents where contains(text, 'the') and not starts_with(text, 'A')")
def text_filter(spark, sf):
    docs = _set(spark, sf, "documents").where(F.contains("text", F.lit("the")) & ~F.startswith("text", F.lit("A")))
    return docs.select("doc_id", F.length("text").alias("size")).frame


# ---- projection and filters ----


@query("select o_orderkey, round(o_totalprice * 2, 2) as twice, upper(o_orderpriority) as priority from orders")
def select_project(spark, sf):
    return _set(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("twice"), F.upper("o_orderpriority").alias("priority")).frame


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 30 and l_discount < 0.05 and l_returnflag <> 'N'")
def where_filter(spark, sf):
    items = _set(spark, sf, "lineitem").where((F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05) & (F.col("l_returnflag") != "N"))
    return items.select("l_orderkey", "l_linenumber", "l_quantity").frame


@query(
    "select o_orderkey, coalesce(nullif(o_custkey % 7, 0), -1) as key, case when o_totalprice > 100000 then 'big' else 'small' end as size, "
    "(o_orderkey // 8)::bigint as block, (o_orderkey & 7)::bigint as low, xor(o_orderkey, 5)::bigint as flipped, (o_orderkey << 2)::bigint as shifted from orders"
)
def scalar_kinds(spark, sf):
    key = F.nullif(F.col("o_custkey") % 7, F.lit(0))
    return _set(spark, sf, "orders").select(
        "o_orderkey",
        scalar.coalesce_to(key, -1).alias("key"),
        scalar.conditional(F.col("o_totalprice") > 100000, F.lit("big"), F.lit("small")).alias("size"),
        scalar.int_div(F.col("o_orderkey"), F.lit(8)).alias("block"),
        F.col("o_orderkey").bitwiseAND(7).alias("low"),
        F.col("o_orderkey").bitwiseXOR(F.lit(5).cast("long")).alias("flipped"),
        F.shiftleft("o_orderkey", 2).alias("shifted"),
    ).frame


@query("select row_number() over (order by event_id) - 1 as idx, event_id, event_type from events")
def select_indexed(spark, sf):
    return _events(spark, sf).select_indexed("idx", "event_id", "event_type").frame


@query("select event_id from (select event_id, row_number() over (order by event_id) - 1 as idx from events) where idx % 7 = 3")
def where_indexed(spark, sf):
    return _events(spark, sf).where_indexed(F.col("idx") % 7 == 3).select("event_id").frame


@query("select idx, event_id, unnest([event_type, user_id::varchar]) as item from (select *, row_number() over (order by event_id) - 1 as idx from events)")
def select_many_indexed(spark, sf):
    items = F.array(F.col("event_type"), F.col("user_id").cast("string"))
    return _events(spark, sf).select_many_indexed(items, "item", ["event_id"]).frame


@query("select idx, event_id, unnest([event_type, user_id::varchar]) as item from (select *, row_number() over (order by event_id) - 1 as idx from events)")
def select_many_indexed_whole(spark, sf):
    items = F.array(F.col("event_type"), F.col("user_id").cast("string"))
    return _events(spark, sf).select_many_indexed(items, "item", ["event_id"]).frame


# ---- joins ----


@query("select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey")
def join_inner(spark, sf):
    return _set(spark, sf, "orders").join(_set(spark, sf, "customer"), ["o_custkey"], ["c_custkey"], lambda o, c: [o["o_orderkey"], c["c_name"], o["o_totalprice"]]).frame


_ORDER_KEYS = "(select o_orderkey, nullif(o_custkey % 7, 0) as k from orders)"
_NATION_KEYS = "(select n_name, nullif(n_nationkey % 7, 0)::bigint as k from nation)"


def _null_keys(spark, sf) -> tuple[Dataset, Dataset]:
    orders = _set(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("k"))
    nations = _set(spark, sf, "nation").select("n_name", F.nullif(F.col("n_nationkey") % 7, F.lit(0)).cast("long").alias("k"))
    return orders, nations


@query(f"select o_orderkey, o.k, n_name from {_ORDER_KEYS} o join {_NATION_KEYS} n on o.k is not distinct from n.k")
def join_nullsafe(spark, sf):
    orders, nations = _null_keys(spark, sf)
    return orders.join(nations, ["k"], ["k"], lambda o, n: [o["o_orderkey"], o["k"], n["n_name"]]).frame


@query(f"select o_orderkey, o.k, n_name from {_ORDER_KEYS} o join {_NATION_KEYS} n on o.k = n.k")
def join_null_skipping(spark, sf):
    orders, nations = _null_keys(spark, sf)
    return orders.join(nations, ["k"], ["k"], lambda o, n: [o["o_orderkey"], o["k"], n["n_name"]], null_safe=False).frame


@query("select l_orderkey, l_linenumber, s_name, n_name from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_quantity >= 49")
def join_chain(spark, sf):
    items = _set(spark, sf, "lineitem").where(F.col("l_quantity") >= 49)
    joined = items.join(_set(spark, sf, "supplier"), ["l_suppkey"], ["s_suppkey"])
    return joined.join(_set(spark, sf, "nation"), ["s_nationkey"], ["n_nationkey"]).select("l_orderkey", "l_linenumber", "s_name", "n_name").frame


_BIG = "(select * from orders where o_totalprice > 200000)"


def _big_orders(spark, sf) -> Dataset:
    return _set(spark, sf, "orders").where(F.col("o_totalprice") > 200000)


@query(
    f"select c_custkey, count(o_orderkey) as n_orders, max(o_orderkey) as last_order from customer left join {_BIG} o on c_custkey = o_custkey group by c_custkey"
)
def group_join_counts(spark, sf):
    joined = _set(spark, sf, "customer").group_join(_big_orders(spark, sf), ["c_custkey"], ["o_custkey"], {"n_orders": F.count("*"), "last_order": F.max("o_orderkey")})
    return joined.select("c_custkey", "n_orders", "last_order").frame


@query(f"select c_custkey, count(o_orderkey)::int as size, coalesce(sum(o_orderkey), 0)::bigint as keys from customer left join {_BIG} o on c_custkey = o_custkey group by c_custkey")
def group_join_nested(spark, sf):
    joined = _set(spark, sf, "customer").group_join(_big_orders(spark, sf).select("o_custkey", "o_orderkey"), ["c_custkey"], ["o_custkey"])
    keys = F.aggregate("group", F.lit(0).cast("long"), lambda a, o: a + o["o_orderkey"])
    return joined.select("c_custkey", F.size("group").alias("size"), keys.alias("keys")).frame


@query(f"select c_custkey, o_orderkey from customer left join {_BIG} o on c_custkey = o_custkey")
def left_outer_idiom(spark, sf):
    joined = _set(spark, sf, "customer").group_join(_big_orders(spark, sf).select("o_custkey", "o_orderkey"), ["c_custkey"], ["o_custkey"])
    return joined.frame.select("c_custkey", F.explode_outer("group").alias("o")).select("c_custkey", F.col("o.o_orderkey").alias("o_orderkey"))


@query(f"select c_custkey, c_name from customer where exists (select 1 from {_BIG} o where o_custkey = c_custkey)")
def semi_idiom(spark, sf):
    return _set(spark, sf, "customer").semi_join(_big_orders(spark, sf), ["c_custkey"], ["o_custkey"]).select("c_custkey", "c_name").frame


@query(f"select c_custkey, c_name from customer where not exists (select 1 from {_BIG} o where o_custkey = c_custkey)")
def anti_idiom(spark, sf):
    return _set(spark, sf, "customer").anti_join(_big_orders(spark, sf), ["c_custkey"], ["o_custkey"]).select("c_custkey", "c_name").frame


@query("select s_suppkey, p_partkey from supplier full join (select * from part where p_partkey % 3 = 0) p on s_suppkey = p_partkey")
def full_outer_join(spark, sf):
    parts = _set(spark, sf, "part").where(F.col("p_partkey") % 3 == 0)
    return _set(spark, sf, "supplier").join(parts, ["s_suppkey"], ["p_partkey"], null_safe=False, how="full").select("s_suppkey", "p_partkey").frame


@query("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey < b.n_regionkey and a.n_nationkey < b.n_nationkey")
def cross_product_theta(spark, sf):
    a = _table(spark, sf, "nation").alias("a")
    b = _table(spark, sf, "nation").alias("b")
    theta = (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return relational.cross_product(a, b, theta, lambda *_: [F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b")])


@query("select r_name, n_name from region cross join nation")
def cross_product_all(spark, sf):
    return _set(spark, sf, "region").cross_product(_set(spark, sf, "nation")).select("r_name", "n_name").frame


@query("select o_orderkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'F'")
def broadcast_lookup(spark, sf):
    """Nations are sent to each partition of the joined orders, through a function over batches."""
    orders = _set(spark, sf, "orders").where(F.col("o_orderstatus") == "F").join(_set(spark, sf, "customer"), ["o_custkey"], ["c_custkey"])

    def look_up(batches, nations):
        names = nations.set_index("n_nationkey")["n_name"]
        for batch in batches:
            yield pd.DataFrame({"o_orderkey": batch["o_orderkey"], "n_name": batch["c_nationkey"].map(names)})

    return orders.select("o_orderkey", "c_nationkey").apply_with_broadcast(_set(spark, sf, "nation").select("n_nationkey", "n_name"), look_up, "o_orderkey long, n_name string").frame


@query("select copy, n_nationkey from nation, (select unnest(range(3))::int as copy)")
def broadcast_copies(spark, sf):
    return _set(spark, sf, "nation").broadcast_copies(3).select("copy", "n_nationkey").frame


# ---- groups ----


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity::bigint)::bigint as quantity from lineitem group by all")
def group_key_result(spark, sf):
    return _set(spark, sf, "lineitem").group_by("l_returnflag", "l_linestatus", aggregates={"n": F.count("*"), "quantity": F.sum(F.col("l_quantity").cast("long"))}).frame


@query("select event_type, count(*)::int as size, min(event_id) as first_event from events group by event_type")
def group_key(spark, sf):
    groups = _events(spark, sf).select("event_type", "event_id").group_by("event_type")
    return groups.select("event_type", F.size("group").alias("size"), F.array_min(F.transform("group", lambda r: r["event_id"])).alias("first_event")).frame


@query("select event_type, count(distinct user_id)::int as users, max(user_id) as last_user from events group by event_type")
def group_key_elem(spark, sf):
    groups = _events(spark, sf).group_by("event_type", element=F.col("user_id"))
    return groups.select("event_type", F.size(F.array_distinct("group")).alias("users"), F.array_max("group").alias("last_user")).frame


@query("select user_id, sum(round(value * 100)::bigint)::bigint as cents, max(round(value * 100)::bigint) as most from events group by user_id")
def group_key_elem_result(spark, sf):
    return _events(spark, sf).select("user_id", _cents().alias("cents")).group_by("user_id", aggregates={"cents": F.sum("cents"), "most": F.max("cents")}).select("user_id", "cents", "most").frame


@query("select event_type, count(distinct user_id) as users from events group by event_type")
def group_distinct_inside(spark, sf):
    return _events(spark, sf).group_by("event_type", aggregates={"users": F.count_distinct("user_id")}).frame


@query(
    "select l_returnflag, count(*) as n, count_if(l_quantity > 25)::bigint as many, bool_or(l_tax > 0.07) as some, bool_and(l_quantity > 0) as every, "
    "min(l_shipdate) as first_ship, max(l_linenumber) as line, bool_or(l_linenumber = 7) as has_seven, count(distinct l_linenumber) as lines from lineitem group by l_returnflag"
)
def group_reductions(spark, sf):
    return _set(spark, sf, "lineitem").group_by("l_returnflag", aggregates={
        "n": F.count("*"), "many": F.count_if(F.col("l_quantity") > 25), "some": F.bool_or(F.col("l_tax") > 0.07),
        "every": F.bool_and(F.col("l_quantity") > 0), "first_ship": F.min("l_shipdate"), "line": F.max("l_linenumber"),
        "has_seven": F.bool_or(F.col("l_linenumber") == 7), "lines": F.count_distinct("l_linenumber"),
    }).frame


@query("select min(c_mktsegment) as key, count(*) as n from customer group by lower(substr(c_mktsegment, 1, 1))")
def group_by_comparer(spark, sf):
    return A.group_by_normalised(_table(spark, sf, "customer"), "c_mktsegment", F.lower(F.substring("c_mktsegment", 1, 1)), {"n": F.count("*")})


@query("select nullif(o_custkey % 7, 0) as k, count(*) as n from orders group by 1")
def group_null_key(spark, sf):
    return _set(spark, sf, "orders").group_by(F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("k"), aggregates={"n": F.count("*")}).frame


@query("select num, inner_num, count(*) as n from (select (event_id % 10)::bigint as num, case when event_id % 2 = 0 then event_id % 5 end as inner_num from events) group by all")
def group_nested_key(spark, sf):
    inner = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 5).alias("inner_num"))
    keyed = _events(spark, sf).select(F.struct((F.col("event_id") % 10).alias("num"), inner.alias("inner")).alias("key"))
    return keyed.group_by("key", aggregates={"n": F.count("*")}).select(F.col("key.num").alias("num"), F.col("key.inner.inner_num").alias("inner_num"), "n").frame


@query(
    "select event_type, min(event_id) as first_event, max(event_id) as last_event, arg_max(user_id, event_id) as last_user from events group by event_type"
)
def group_first_last(spark, sf):
    return _events(spark, sf).group_by("event_type", aggregates={"first_event": F.min("event_id"), "last_event": F.max("event_id"), "last_user": F.max_by("user_id", "event_id")}).frame


# ---- scalar aggregates ----


def _aggregate(name: str, sql: str, build: Callable[[SparkSession, str], Dataset]) -> None:
    def run(spark, sf):
        return build(spark, sf).frame

    run.__name__ = name
    query(sql)(run)


def _items(spark, sf) -> Dataset:
    return _set(spark, sf, "lineitem")


_PRICE = "l_extendedprice::decimal(18,2)"
_NONE = "l_quantity < 0"
_ODD = "case when l_linenumber % 2 = 1 then l_linenumber end"


def _decimal():
    return F.col("l_extendedprice").cast("decimal(18,2)")


def _odd():
    return F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber"))


for _name, _sql, _build in [
    ("agg_count", "select count(*)::int as result from lineitem", lambda s, d: _items(s, d).count_as_query()),
    ("agg_long_count", "select count(*) as result from lineitem", lambda s, d: _items(s, d).long_count_as_query()),
    ("agg_count_pred", "select count_if(l_quantity > 25)::int as result from lineitem", lambda s, d: _items(s, d).count_as_query(F.col("l_quantity") > 25)),
    ("agg_long_count_pred", "select count(*) filter (where l_quantity > 25) as result from lineitem", lambda s, d: _items(s, d).long_count_as_query(F.col("l_quantity") > 25)),
    ("agg_sum_int", "select sum(l_linenumber)::int as result from lineitem", lambda s, d: _items(s, d).sum_as_query("l_linenumber")),
    ("agg_sum_long", "select sum(l_orderkey)::bigint as result from lineitem", lambda s, d: _items(s, d).sum_as_query("l_orderkey")),
    ("agg_sum_double", "select sum(l_quantity) as result from lineitem", lambda s, d: _items(s, d).sum_as_query("l_quantity")),
    ("agg_sum_float", "select sum(l_quantity)::float as result from lineitem", lambda s, d: _items(s, d).sum_as_query(F.col("l_quantity").cast("float"))),
    ("agg_sum_decimal", f"select sum({_PRICE})::decimal(28,2) as result from lineitem", lambda s, d: _items(s, d).sum_as_query(_decimal())),
    ("agg_sum_nullable", f"select coalesce(sum({_ODD}), 0)::int as result from lineitem", lambda s, d: _items(s, d).sum_as_query(_odd())),
    ("agg_sum_empty", f"select coalesce(sum(l_linenumber), 0)::int as result from lineitem where {_NONE}", lambda s, d: _items(s, d).where(F.expr(_NONE)).sum_as_query("l_linenumber")),
    ("agg_min", "select min(l_extendedprice) as result from lineitem", lambda s, d: _items(s, d).min_as_query("l_extendedprice", strict=True)),
    ("agg_max", "select max(l_shipdate) as result from lineitem", lambda s, d: _items(s, d).max_as_query("l_shipdate", strict=True)),
    ("agg_min_selector", "select min(l_quantity * l_linenumber) as result from lineitem", lambda s, d: _items(s, d).min_as_query(F.col("l_quantity") * F.col("l_linenumber"))),
    ("agg_max_text", "select max(c_name) as result from customer", lambda s, d: _set(s, d, "customer").max_as_query("c_name")),
    ("agg_min_empty", f"select min(l_linenumber) as result from lineitem where {_NONE}", lambda s, d: _items(s, d).where(F.expr(_NONE)).min_as_query("l_linenumber")),
    ("agg_avg_int", "select avg(l_linenumber) as result from lineitem", lambda s, d: _items(s, d).average_as_query("l_linenumber", strict=True)),
    ("agg_avg_long", "select avg(l_partkey) as result from lineitem", lambda s, d: _items(s, d).average_as_query("l_partkey")),
    ("agg_avg_nullable", f"select avg({_ODD}) as result from lineitem", lambda s, d: _items(s, d).average_as_query(_odd())),
    ("agg_avg_float", "select avg(l_quantity)::float as result from lineitem", lambda s, d: _items(s, d).average_as_query(F.col("l_quantity").cast("float"))),
    ("agg_avg_empty", f"select avg(l_linenumber) as result from lineitem where {_NONE}", lambda s, d: _items(s, d).where(F.expr(_NONE)).average_as_query("l_linenumber")),
    ("agg_any", "select count(*) > 0 as result from orders", lambda s, d: _set(s, d, "orders").any_as_query()),
    ("agg_any_pred", "select coalesce(bool_or(o_totalprice > 1e9), false) as result from orders", lambda s, d: _set(s, d, "orders").any_as_query(F.col("o_totalprice") > 1e9)),
    ("agg_all", "select coalesce(bool_and(o_totalprice > 0), true) as result from orders", lambda s, d: _set(s, d, "orders").all_as_query(F.col("o_totalprice") > 0)),
    ("agg_all_empty", "select true as result", lambda s, d: _set(s, d, "orders").where(F.lit(False)).all_as_query(F.col("o_totalprice") < 0)),
    ("agg_contains", "select count(*) > 0 as result from customer where c_mktsegment = 'BUILDING'", lambda s, d: _set(s, d, "customer").contains_as_query("c_mktsegment", "BUILDING")),
    ("agg_contains_comparer", "select count(*) > 0 as result from customer where lower(c_mktsegment) = 'building'", lambda s, d: _set(s, d, "customer").contains_as_query("c_mktsegment", "Building", F.lower)),
    ("agg_first", "select event_id, event_type from events order by event_id limit 1", lambda s, d: _events(s, d).first_as_query().select("event_id", "event_type")),
    ("agg_first_pred", "select event_id, value from events where value > 50 order by event_id limit 1", lambda s, d: _events(s, d).first_as_query(F.col("value") > 50).select("event_id", "value")),
    ("agg_last", "select event_id, event_type from events order by event_id desc limit 1", lambda s, d: _events(s, d).last_as_query().select("event_id", "event_type")),
    ("agg_last_pred", "select event_id, value from events where value > 50 order by event_id desc limit 1", lambda s, d: _events(s, d).last_as_query(F.col("value") > 50).select("event_id", "value")),
    ("agg_single", "select r_regionkey, r_name from region where r_regionkey = 3", lambda s, d: _set(s, d, "region").single_as_query(F.col("r_regionkey") == 3)),
]:
    _aggregate(_name, _sql, _build)


def _row(spark: SparkSession, kind: str, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], kind)


@query("select bit_xor(event_id)::bigint as result from events")
def agg_fold(spark, sf):
    """A sequential fold in event order."""
    return _row(spark, "result long", r=_events(spark, sf).fold("event_id", 0, lambda a, x: a ^ x))


@query("select bit_xor(event_id)::bigint as result from events")
def agg_fold_assoc(spark, sf):
    """The same fold as an associative one: partial values per partition."""
    return decompose.associative(_table(spark, sf, "events").repartition(7), "event_id", int, lambda a, b: int(a) ^ int(b), "long")


@query("select max(event_id) as result from events")
def agg_fold_seed_factory(spark, sf):
    folded = _events(spark, sf).fold("event_id", list, lambda a, x: [*a[-1:], x], lambda a: a[-1])
    return _row(spark, "result long", r=folded)


@query("select (select count(*) from lineitem)::int as n, (select sum(l_linenumber) from lineitem)::bigint as total, (select max(event_id) from events) as last, (select count(*) > 0 from region where r_name = 'ASIA') as has")
def scalar_values(spark, sf):
    """Aggregates that return values to the caller."""
    items = _items(spark, sf)
    return _row(
        spark, "n int, total long, last long, has boolean",
        n=items.count(), total=items.sum("l_linenumber"), last=_events(spark, sf).last()["event_id"], has=_set(spark, sf, "region").contains("r_name", "ASIA"),
    )


# ---- order and position ----


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey")
def order_by_total(spark, sf):
    return _set(spark, sf, "orders").select("o_orderkey", "o_totalprice").order_by(F.desc("o_totalprice"), F.asc("o_orderkey")).frame


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k_orders(spark, sf):
    return Dataset(order_by_total(spark, sf), (F.desc("o_totalprice"), F.asc("o_orderkey"))).take(25).frame


@query("select event_id, value from events where event_id < coalesce((select min(event_id) from events where not (value < 95)), 9223372036854775807)")
def take_while(spark, sf):
    return _events(spark, sf).take_while(F.col("value") < 95).select("event_id", "value").frame


@query("select event_id, value from events where event_id >= (select min(event_id) from events where not (value < 95))")
def skip_while(spark, sf):
    return _events(spark, sf).skip_while(F.col("value") < 95).select("event_id", "value").frame


@query("select event_id from (select event_id, row_number() over (order by event_id) - 1 as idx from events) where idx < 125")
def take_while_idx(spark, sf):
    return _events(spark, sf).take_while(F.col("idx") < 125).select("event_id").frame


@query("select event_id from (select event_id, row_number() over (order by event_id) - 1 as idx from events) where idx >= 125")
def skip_while_idx(spark, sf):
    return _events(spark, sf).skip_while(F.col("idx") < 125).select("event_id").frame


@query("select event_id from events order by event_id limit 77")
def take_first(spark, sf):
    return _events(spark, sf).take(77).select("event_id").frame


@query("select event_id from events order by event_id offset 250")
def skip(spark, sf):
    return _events(spark, sf).skip(250).select("event_id").frame


@query("select row_number() over (order by event_id desc) - 1 as idx, event_id from events")
def reverse_idx(spark, sf):
    return _events(spark, sf).reverse().with_index().select("idx", "event_id").frame


@query(
    "select idx, a.event_id as a, b.event_id as b from (select event_id, row_number() over (order by event_id) - 1 as idx from events) a "
    "join (select event_id, row_number() over (order by event_id desc) - 1 as idx from events where event_type <> 'click') b using (idx)"
)
def zip_tables(spark, sf):
    other = _events(spark, sf).where(F.col("event_type") != "click").reverse()
    zipped = _events(spark, sf).select("event_id").zip(Dataset(other.frame.select("event_id"), other.order))
    return zipped.select("idx", F.col("left.event_id").alias("a"), F.col("right.event_id").alias("b")).frame


@query("select true as same, false as shifted")
def sequence_equal(spark, sf):
    events = _events(spark, sf).select("event_id", "user_id")
    same = events.sequence_equal(Dataset(events.frame.repartition(5), events.order))
    shifted = events.sequence_equal(events.skip(1))
    return _row(spark, "same boolean, shifted boolean", a=same, b=shifted)


_WINDOW = "over (order by event_id rows between current row and {0} following)"


def _sliding_sql(size: int, expression: str) -> str:
    frame = _WINDOW.format(size - 1)
    return (
        f"select idx, {expression} from (select row_number() over (order by event_id) - 1 as idx, sum(c) {frame} as total, max(c) {frame} as most, "
        f"first(event_id) {frame} as a, last(event_id) {frame} as b, count(*) {frame} as n from (select event_id, round(value * 100)::bigint as c from events)) where n = {size}"
    )


def _cent_events(spark, sf) -> Dataset:
    return _events(spark, sf).select("event_id", _cents().alias("cents"))


@query(_sliding_sql(3, "total::bigint as total, most"))
def sliding_sum3(spark, sf):
    return _cent_events(spark, sf).sliding_window(3, {"total": F.sum("cents"), "most": F.max("cents")}).frame


@query(_sliding_sql(10, "(b - a)::bigint as result"))
def sliding_apply10(spark, sf):
    return _cent_events(spark, sf).sliding_window(10, apply=lambda rows: F.get(rows, F.lit(9))["event_id"] - F.get(rows, F.lit(0))["event_id"]).frame


@query("select event_id, user_id from events")
def check_order_by(spark, sf):
    return _events(spark, sf).select("event_id", "user_id").order_by("event_id").check_order_by("event_id").frame


@query("select event_id, event_type from (select *, row_number() over (order by event_id) - 1 as idx from events) where idx = 42")
def element_at(spark, sf):
    row = _events(spark, sf).element_at(42)
    return _row(spark, "event_id long, event_type string", a=row["event_id"], b=row["event_type"])


# ---- sets ----

_A = "(select c_nationkey as k from customer where c_acctbal > 0)"
_B = "(select s_nationkey as k from supplier)"


def _key_sets(spark, sf) -> tuple[Dataset, Dataset]:
    a = _set(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_nationkey").alias("k"))
    return a, _set(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))


for _name, _word, _build in [
    ("concat_all", "union all", lambda a, b: a.concat(b)),
    ("union_distinct", "union", lambda a, b: a.union(b)),
    ("intersect_keys", "intersect", lambda a, b: a.intersect(b)),
    ("except_keys", "except", lambda a, b: a.except_(b)),
]:
    _aggregate(_name, f"select k from {_A} {_word} select k from {_B}", lambda s, d, build=_build: build(*_key_sets(s, d)))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def distinct_rows(spark, sf):
    return _set(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct().frame


@query("select min(c_mktsegment) as c_mktsegment from customer group by lower(substr(c_mktsegment, 1, 1))")
def distinct_comparer(spark, sf):
    return _set(spark, sf, "customer").select("c_mktsegment").distinct(F.lower(F.substring("c_mktsegment", 1, 1)), F.col("c_mktsegment")).frame


@query("select distinct k // 3 as third from (select n_nationkey as k from nation) where k // 3 in (select r_regionkey from region)")
def intersect_comparer(spark, sf):
    a = _set(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    b = _set(spark, sf, "region").select((F.col("r_regionkey") * 3).alias("k"))
    return a.intersect(b, lambda f: F.floor(f["k"] / 3)).select(F.floor(F.col("k") / 3).cast("int").alias("third")).frame


# ---- partitions and dataflow ----


@query("select o_custkey, 1::bigint as parts, count(*) as n from orders group by o_custkey")
def hash_partition_groups(spark, sf):
    placed = _set(spark, sf, "orders").hash_partition("o_custkey", count=6).select("o_custkey", F.spark_partition_id().alias("pid"))
    return placed.group_by("o_custkey", aggregates={"parts": F.count_distinct("pid"), "n": F.count("*")}).frame


@query("select (o_orderkey * 2)::bigint as twice, o_orderstatus from orders")
def hash_partition_result(spark, sf):
    return _set(spark, sf, "orders").hash_partition("o_orderkey", count=4, result=[(F.col("o_orderkey") * 2).alias("twice"), F.col("o_orderstatus")]).frame


def _range_sql(steps: str) -> str:
    return f"select pid, min(o_orderkey) as low, max(o_orderkey) as high, count(*) as n from (select o_orderkey, ({steps})::int as pid from orders) group by pid"


def _ranges(dataset: Dataset) -> DataFrame:
    placed = dataset.select("o_orderkey", F.spark_partition_id().alias("pid"))
    return placed.group_by("pid", aggregates={"low": F.min("o_orderkey"), "high": F.max("o_orderkey"), "n": F.count("*")}).frame


@query(_range_sql("(o_orderkey > 200)::int + (o_orderkey > 5000)::int + (o_orderkey > 8000)::int"))
def range_partition_explicit(spark, sf):
    return _ranges(_set(spark, sf, "orders").range_partition("o_orderkey", separators=[200, 5000, 8000]))


@query(_range_sql("(o_orderkey < 8000)::int + (o_orderkey < 5000)::int + (o_orderkey < 200)::int"))
def range_partition_descending(spark, sf):
    return _ranges(_set(spark, sf, "orders").range_partition("o_orderkey", separators=[8000, 5000, 200], descending=True))


@query("select count(*) as n, 0::bigint as overlaps, true as spread from orders")
def range_partition_auto(spark, sf):
    ranges = _ranges(_set(spark, sf, "orders").range_partition("o_orderkey", count=5))
    a, b = ranges.alias("a"), ranges.alias("b")
    crossing = a.join(b, (F.col("a.pid") < F.col("b.pid")) & (F.col("a.high") > F.col("b.low"))).count()
    return ranges.agg(F.sum("n").alias("n"), F.lit(crossing).cast("long").alias("overlaps"), (F.count("*") > 1).alias("spread"))


for _name, _build in [
    ("assume_hash_partition", lambda n: n.assume_hash_partition("n_nationkey")),
    ("assume_range_partition", lambda n: n.assume_range_partition("n_nationkey", separators=[5, 10], count=3)),
    ("assume_order_by", lambda n: n.assume_order_by("n_nationkey")),
]:
    _aggregate(_name, "select n_nationkey, n_name from nation", lambda s, d, build=_build: build(_set(s, d, "nation")).select("n_nationkey", "n_name"))


def _total(batches):
    for batch in batches:
        yield pd.DataFrame({"total": [int(batch["event_id"].sum())], "n": [len(batch)]})


@query("select sum(event_id)::bigint as total, count(*) as n from events")
def apply_per_partition(spark, sf):
    parts = _events(spark, sf).select("event_id").hash_partition("event_id", count=5).apply_per_partition(_total, "total long, n long")
    return parts.frame.agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


@query("select event_id, (event_id - lag(event_id) over (order by event_id))::bigint as gap from events")
def apply_whole(spark, sf):
    def gaps(batches):
        last = None
        for batch in batches:
            before = batch["event_id"].shift(1).astype("Int64")
            if last is not None and len(batch):
                before.iloc[0] = last
            if len(batch):
                last = int(batch["event_id"].iloc[-1])
            yield pd.DataFrame({"event_id": batch["event_id"], "gap": batch["event_id"] - before})

    return _events(spark, sf).select("event_id").apply(gaps, "event_id long, gap long").frame


@query("select (select count(*) from region) as a, (select count(*) from nation) as b")
def apply_binary(spark, sf):
    def sizes(a, b):
        return pd.DataFrame({"a": [len(a)], "b": [len(b)]})

    return _set(spark, sf, "region").apply_binary(_set(spark, sf, "nation"), sizes, "a long, b long").frame


@query("select (select count(*) from nation) as n, (select sum(n_nationkey) from nation)::bigint as keys")
def apply_pairwise(spark, sf):
    def sizes(a, b):
        return pd.DataFrame({"n": [len(a)], "keys": [int(b["n_nationkey"].sum()) if len(b) else 0]})

    nations = _set(spark, sf, "nation")
    a, b = (Dataset(nations.frame.repartitionById(3, (F.col("n_nationkey") % 3).cast("int"))) for _ in range(2))
    return a.apply_pairwise(b, sizes, "n long, keys long").frame.agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))


@query("select 0::bigint as source, count(*) as n from region union all select 1, count(*) from (select n_nationkey from nation where n_nationkey > 10) union all select 2, count(*) from nation")
def apply_many(spark, sf):
    def sizes(tables):
        return pd.DataFrame({"source": range(len(tables)), "n": [len(t) for t in tables]})

    nations = _set(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    return _set(spark, sf, "region").select(F.col("r_regionkey").alias("k")).apply_many([nations.where(F.col("k") > 10), nations], sizes, "source long, n long").frame


@query("select (o_orderkey > 700)::int as pid, count(*) as n from orders group by 1")
def apply_partition_index(spark, sf):
    def sizes(batches, index):
        yield pd.DataFrame({"pid": [index], "n": [sum(len(b) for b in batches)]})

    return _set(spark, sf, "orders").select("o_orderkey").range_partition("o_orderkey", separators=[700]).apply_with_partition_index(sizes, "pid int, n long").frame


@query("select case when value > 50 then 'high' else 'low' end as branch, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def fork_two(spark, sf):
    high = F.col("value") > 50
    row = F.struct("event_id", "value")
    forked = _events(spark, sf).fork(high=F.when(high, row), low=F.when(~high, row))
    return _branches(forked)


def _branches(forked: partition.Forked) -> DataFrame:
    out = None
    for name in forked.keys():
        own = forked[name].agg(F.lit(name).alias("branch"), F.count("*").alias("n"), F.sum("event_id").alias("ids"))
        out = own if out is None else out.unionAll(own)
    return out


@query("select event_type as branch, count(*) as n, sum(event_id)::bigint as ids from events where event_type in ('click', 'purchase') group by 1")
def fork_by_key(spark, sf):
    return _branches(_events(spark, sf).select("event_id", "event_type").fork_by_key(F.col("event_type"), ["click", "purchase"]))


@query("select case event_id % 3 when 0 then 'zero' when 1 then 'one' else 'two' end as branch, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def fork_per_partition(spark, sf):
    def split(batches):
        for batch in batches:
            for k, name in enumerate(("zero", "one", "two")):
                yield name, batch[batch["event_id"] % 3 == k]

    kind = "event_id long"
    return _branches(_events(spark, sf).select("event_id").fork_per_partition(split, {"zero": kind, "one": kind, "two": kind}))


@query("with recursive r as (select p_partkey, p_size::bigint as size from part union all select p_partkey, size // 2 from r where size >= 10) select p_partkey, min(size) as size from r group by p_partkey")
def do_while_halving(spark, sf):
    parts = _set(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))

    def halve(d: Dataset) -> Dataset:
        return d.select("p_partkey", F.when(F.col("size") >= 10, F.floor(F.col("size") / 2)).otherwise(F.col("size")).alias("size"))

    return parts.do_while(halve, lambda before, after: after.any(F.col("size") >= 10)).frame


@query(
    "with recursive r(node) as (select 0::bigint union select (unnest([node * 2 + 1, node * 2 + 2])) from r where node < 200) select node from r where node <= 400"
)
def do_while_reachable(spark, sf):
    """Breadth-first reachability: rounds go on while new nodes appear."""
    def step(d: Dataset) -> Dataset:
        more = d.where(F.col("node") < 200).select_many(F.array(F.col("node") * 2 + 1, F.col("node") * 2 + 2), "next", []).select(F.col("next").alias("node"))
        return d.union(more)

    start = Dataset(spark.range(1).select(F.col("id").alias("node")))
    return start.do_while(step, lambda before, after: after.long_count() > before.long_count()).where(F.col("node") <= 400).frame


class _Average:
    """(sum, count) of one column."""

    def seed(self, row):
        return (row[0], 1)

    def accumulate(self, state, row):
        return (state[0] + row[0], state[1] + 1)

    def merge(self, a, b):
        return (a[0] + b[0], a[1] + b[1])

    def final(self, state):
        return float(state[0]) / state[1]


@query("select l_returnflag, avg(l_linenumber) as result from lineitem group by l_returnflag")
def decomposable_avg(spark, sf):
    return Dataset(_table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber")).aggregate_by(["l_returnflag"], ["l_linenumber"], _Average(), "double").frame


@query("select event_type, round(exp(avg(ln(value + 1))), 4) as result from events group by event_type")
def decomposable_geo(spark, sf):
    mean = decompose.ColumnAggregate({"logs": F.sum(F.ln(F.col("value") + 1)), "n": F.count("*")}, lambda s: F.round(F.exp(s["logs"] / s["n"]), 4))
    return mean.over(_table(spark, sf, "events"), ["event_type"])


# ---- pipelines of several operators ----


@query(
    "select l_returnflag, l_linestatus, sum(l_quantity::decimal(18,2))::decimal(28,2) as sum_qty, sum(l_extendedprice::decimal(18,2))::decimal(28,2) as sum_price, "
    "avg(l_linenumber) as avg_line, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"
)
def pricing_summary(spark, sf):
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    return _items(spark, sf).where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).group_by(
        "l_returnflag", "l_linestatus",
        aggregates={"sum_qty": money("l_quantity"), "sum_price": money("l_extendedprice"), "avg_line": F.avg("l_linenumber"), "n": F.count("*")},
    ).frame


@query(
    "select n_name, sum(round(l_extendedprice * 100)::bigint)::bigint as cents from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey "
    "join nation on c_nationkey = n_nationkey where o_orderstatus = 'O' group by n_name order by cents desc, n_name limit 5"
)
def top_nations(spark, sf):
    orders = _set(spark, sf, "orders").where(F.col("o_orderstatus") == "O")
    items = _items(spark, sf).select("l_orderkey", _cents("l_extendedprice").alias("cents"))
    joined = items.join(orders, ["l_orderkey"], ["o_orderkey"], null_safe=False).join(_set(spark, sf, "customer"), ["o_custkey"], ["c_custkey"], null_safe=False)
    named = joined.join(_set(spark, sf, "nation"), ["c_nationkey"], ["n_nationkey"], null_safe=False)
    return named.group_by("n_name", aggregates={"cents": F.sum("cents")}).order_by(F.desc("cents"), F.asc("n_name")).take(5).frame


# ---- stores ----


def _stored(spark, sf, name: str, data: Dataset, **options) -> Dataset:
    """The dataset after a round through a store in the shared folder."""
    uri = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.{options.pop('suffix', 'parquet')}"
    context = Context(spark)
    context.submit(data.to_store(uri, **options))
    return context.from_store(uri)


@query("select o_orderkey, o_totalprice, o_orderdate from orders")
def store_parquet(spark, sf):
    return _stored(spark, sf, "orders", _set(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), compression="zstd").frame


@query("select n_nationkey || ' ' || n_name as line from nation")
def store_text(spark, sf):
    lines = _set(spark, sf, "nation").select(F.concat_ws(" ", "n_nationkey", "n_name").alias("line"))
    return _stored(spark, sf, "nation", lines, suffix="txt").frame


@query("select c_custkey || '|' || c_name as line from customer")
def store_text_gzip(spark, sf):
    lines = _set(spark, sf, "customer").select(F.concat_ws("|", "c_custkey", "c_name").alias("line"))
    return _stored(spark, sf, "customer", lines, suffix="txt", compression="gzip").frame


@query("select s_suppkey || '|' || s_name as line from supplier")
def store_partfile(spark, sf):
    context = Context(spark)
    lines = _set(spark, sf, "supplier").hash_partition("s_suppkey", count=3).select(F.concat_ws("|", "s_suppkey", "s_name").alias("line"))
    uri = f"partfile:{shared_folder(spark)}/supplier-{uuid.uuid4().hex}.pt"
    context.submit(lines.to_store(uri, compression="gzip"))
    return context.from_store(uri).frame


@query("select 'even' as sink, o_orderkey from orders where o_orderkey % 2 = 0 union all select 'odd', o_orderkey from orders where o_orderkey % 2 <> 0")
def multi_output(spark, sf):
    context, folder = Context(spark), f"{shared_folder(spark)}/sinks-{uuid.uuid4().hex}"
    keys = _set(spark, sf, "orders").select("o_orderkey")
    even, odd = keys.where(F.col("o_orderkey") % 2 == 0), keys.where(F.col("o_orderkey") % 2 != 0)
    context.submit(even.to_store(f"{folder}/even.parquet"), odd.to_store(f"{folder}/odd.parquet"))
    sinks = [context.from_store(f"{folder}/{name}.parquet").select(F.lit(name).alias("sink"), "o_orderkey") for name in ("even", "odd")]
    return sinks[0].concat(sinks[1]).frame


@query("select n_nationkey as value, n_name from nation where n_nationkey in (3, 5, 8)")
def from_enumerable(spark, sf):
    local = Context(spark).from_enumerable([3, 5, 8, 100], "value int")
    return local.join(_set(spark, sf, "nation"), ["value"], ["n_nationkey"], lambda a, b: [a["value"], b["n_name"]]).frame


@query("select 1::bigint as first_found, null::bigint as first_none, 24::bigint as last_found, null::bigint as last_none, 7::bigint as single_found, null::bigint as single_none")
def or_default(spark, sf):
    nations = _set(spark, sf, "nation", "n_nationkey")
    key = lambda row: row and int(row["n_nationkey"])
    above = lambda n: F.col("n_nationkey") > n
    found = [key(nations.first(above(0), default=True)), key(nations.first(above(99), default=True)), key(nations.last(default=True)), key(nations.last(above(99), default=True))]
    found += [key(nations.single(F.col("n_nationkey") == 7, default=True)), key(nations.single(above(99), default=True))]
    names = ["first_found", "first_none", "last_found", "last_none", "single_found", "single_none"]
    return spark.createDataFrame([tuple(found)], ", ".join(f"{n} long" for n in names))


@query("select string_agg(n_name, '>' order by n_nationkey) as result from nation")
def aggregate_as_query(spark, sf):
    nations = _set(spark, sf, "nation", "n_nationkey")
    return nations.aggregate_as_query("n_name", lambda: [], lambda state, name: [*state, name], "string", ">".join).frame


@query("select bit_xor(event_id)::bigint as result from events")
def associative_as_query(spark, sf):
    return _events(spark, sf).associative_as_query("event_id", lambda: 0, lambda a, b: int(a) ^ int(b), "long").frame


@query("select (select count(*) from nation) as nations, (select count(*) from supplier) as suppliers, (select count(*) from customer) as customers")
def apply_per_partition_many(spark, sf):
    def sizes(frames):
        return pd.DataFrame({n: [len(f)] for n, f in zip(("nations", "suppliers", "customers"), frames, strict=True)})

    keys = {"nation": "n_nationkey", "supplier": "s_nationkey", "customer": "c_nationkey"}
    parts = [Dataset(_table(spark, sf, t).repartitionById(4, (F.col(k) % 4).cast("int"))) for t, k in keys.items()]
    counted = parts[0].apply_per_partition_many(parts[1:], sizes, "nations long, suppliers long, customers long").frame
    return counted.agg(*[F.sum(c).alias(c) for c in counted.columns])


@query("select r_name as name, (select count(*) from nation where n_regionkey = r_regionkey) as nations from region")
def apply_mixed(spark, sf):
    def named(frames):
        regions, nations = frames
        counts = nations.groupby("n_regionkey").size()
        return pd.DataFrame({"name": regions["r_name"], "nations": [int(counts.get(k, 0)) for k in regions["r_regionkey"]]})

    return _set(spark, sf, "region").apply_many([_set(spark, sf, "nation").select("n_regionkey")], named, "name string, nations long").frame


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
