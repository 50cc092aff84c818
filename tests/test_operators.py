import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.dataset import Dataset
from lattica.errors import (
    BadIteration,
    BadPartitionCount,
    BadSeparators,
    BadStore,
    BadWindow,
    Disposed,
    DuplicateStore,
    EmptySequence,
    MoreThanOne,
    NameClash,
    NotOrdered,
    OrderRequired,
    PartitionMismatch,
    StoreExists,
    UnknownScheme,
)
from lattica.functions import scalar
from lattica.operators import aggregates as A
from lattica.operators import decompose, ordering, partition, relational
from lattica.session import Context
from lattica.sources.stores import Provider, partfile_paths, read_partfile_index, register
from lattica.streaming import events


@pytest.fixture(scope="module")
def context(spark):
    return Context(spark)


def numbers(spark, n, parts=3):
    return Dataset(spark.range(n).select(F.col("id").alias("x")).repartition(parts), ("x",))


def values(dataset, column="x"):
    return [r[column] for r in dataset.frame.collect()]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_positions_do_not_depend_on_partitions(spark, parts):
    d = numbers(spark, 200, parts)
    indexed = {r["x"]: r["idx"] for r in d.with_index().frame.collect()}
    assert indexed == {k: k for k in range(200)}
    assert sorted(values(d.take_while(F.col("idx") < 125))) == list(range(125))
    assert sorted(values(d.skip_while(F.col("x") < 6))) == list(range(6, 200))
    assert sorted(values(d.skip(190))) == list(range(190, 200))
    assert values(d.reverse().take(3)) == [199, 198, 197]


def test_take_while_of_all_and_none(spark):
    d = numbers(spark, 10)
    assert d.take_while(F.lit(True)).count() == 10 and d.skip_while(F.lit(True)).count() == 0
    assert d.take_while(F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5, 9])
def test_sliding_window_over_small_partitions(spark, size):
    d = numbers(spark, 23, 11)
    from lattica.operators.window import sliding_window

    got = sliding_window(d.frame, ["x"], size, {"s": F.sum("x")}, block=4).orderBy("idx").collect()
    assert [r["s"] for r in got] == [sum(range(k, k + size)) for k in range(23 - size + 1)]


def test_sliding_window_bounds(spark):
    assert numbers(spark, 3).sliding_window(4, {"s": F.sum("x")}).count() == 0
    with pytest.raises(BadWindow):
        numbers(spark, 3).sliding_window(0, {"s": F.sum("x")})


def test_scalars_of_nothing(spark):
    none = numbers(spark, 5).where(F.lit(False))
    assert none.sum("x") == 0 and none.min("x") is None and none.average("x") is None
    assert none.any() is False and none.all(F.col("x") > 9) is True and none.count() == 0
    with pytest.raises(Exception, match="EmptySequence"):
        none.max("x", strict=True)
    with pytest.raises(EmptySequence):
        none.first()
    assert none.first(default=True) is None


def test_sums_keep_their_type_and_overflow_raises(spark):
    small = Dataset(spark.createDataFrame([(2**31 - 1,), (1,)], "x int"))
    with pytest.raises(Exception, match="OVERFLOW"):
        small.sum("x")
    some = Dataset(spark.createDataFrame([(1,), (None,)], "x int"))
    assert some.sum("x") == 1 and some.sum_as_query("x").frame.dtypes == [("result", "int")]
    assert Dataset(spark.createDataFrame([(None,)], "x int")).sum("x") == 0


def test_single_first_last(spark):
    d = numbers(spark, 9)
    assert d.single(F.col("x") == 4)["x"] == 4
    with pytest.raises(MoreThanOne):
        d.single(F.col("x") > 4)
    assert (d.first()["x"], d.last()["x"], d.last(F.col("x") < 5)["x"], d.element_at(3)["x"]) == (0, 8, 4, 3)
    with pytest.raises(OrderRequired):
        Dataset(d.frame).first()


def test_null_keys_match_each_other(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    assert relational.join(a, a.select(F.col("k").alias("j"), F.col("v").alias("w")), ["k"], ["j"]).count() == 2
    assert relational.join(a, a.select(F.col("k").alias("j"), F.col("v").alias("w")), ["k"], ["j"], null_safe=False).count() == 1


def test_group_join_keeps_unmatched_rows(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5), (1, 6)], "j int, v int")
    got = {r["k"]: sorted(x["v"] for x in r["group"]) for r in relational.group_join(a, b, ["k"], ["j"]).collect()}
    assert got == {1: [5, 6], 2: []}


def test_separators(spark):
    d = numbers(spark, 12)
    placed = d.range_partition("x", separators=[2, 5, 8]).frame.select("x", F.spark_partition_id().alias("p"))
    got = pd.DataFrame(placed.collect(), columns=["x", "p"]).groupby("p")["x"].apply(sorted).to_dict()
    assert got == {0: [0, 1, 2], 1: [3, 4, 5], 2: [6, 7, 8], 3: [9, 10, 11]}
    down = d.range_partition("x", separators=[8, 5, 2], descending=True).frame.select("x", F.spark_partition_id().alias("p"))
    assert pd.DataFrame(down.collect(), columns=["x", "p"]).groupby("p")["x"].apply(sorted).to_dict() == {0: [8, 9, 10, 11], 1: [5, 6, 7], 2: [2, 3, 4], 3: [0, 1]}
    assert partition.check_separators([6, 6, 3, 1], descending=True) == [6, 6, 3, 1]
    for bad, descending in (([4, 3], False), ([1, 2], True), ([], False), ([1, None], False)):
        with pytest.raises(BadSeparators):
            partition.check_separators(bad, descending)
    with pytest.raises(BadSeparators):
        d.assume_range_partition("x", separators=[1, 2], count=5)


@pytest.mark.parametrize("n", [0, -1])
def test_partition_counts(spark, n):
    with pytest.raises(BadPartitionCount):
        numbers(spark, 3).hash_partition("x", count=n)


def test_check_order_by(spark):
    d = numbers(spark, 50)
    assert d.order_by("x").check_order_by("x").count() == 50
    with pytest.raises(NotOrdered):
        Dataset(spark.createDataFrame([(2,), (1,)], "x int").coalesce(1)).check_order_by("x")


def test_pairwise_needs_equal_counts(spark):
    with pytest.raises(PartitionMismatch):
        numbers(spark, 4, 2).apply_pairwise(numbers(spark, 4, 3), lambda a, b: a, "x long")


def test_fork_by_key_drops_other_keys(spark):
    forked = numbers(spark, 10).fork_by_key(F.col("x") % 3, [0, 1])
    assert {k: sorted(r["x"] for r in forked[k].collect()) for k in forked.keys()} == {0: [0, 3, 6, 9], 1: [1, 4, 7]}
    forked.release()


def test_loops(spark):
    d = numbers(spark, 3)
    more = lambda s: s.select((F.col("x") + 1).alias("x"))
    assert sorted(values(d.do_while(more, lambda a, b: False))) == [1, 2, 3]
    assert sorted(values(d.do_while(more, lambda a, b: b.max("x") < 8, count=2))) == [6, 7, 8]
    assert sorted(values(d.do_while(more, lambda a, b: True, count=0))) == [0, 1, 2]
    with pytest.raises(BadIteration):
        d.do_while(more, lambda a, b: True, count=-1)
    assert partition.changed(d.frame, more(d).frame) and not partition.changed(d.frame, d.frame.repartition(2))


def test_broadcast_beyond_the_bound_gives_the_same(spark, monkeypatch):
    def sums(batches, other):
        for batch in batches:
            yield pd.DataFrame({"s": batch["x"] + int(other["x"].sum())})

    d, other = numbers(spark, 20), numbers(spark, 5)
    small = sorted(values(d.apply_with_broadcast(other, sums, "s long"), "s"))
    monkeypatch.setattr(partition, "BROADCAST_ROWS", 2)
    assert small == sorted(values(d.apply_with_broadcast(other, sums, "s long"), "s"))


def test_decomposable_with_null_keys_and_early_flush(spark, monkeypatch):
    monkeypatch.setattr(decompose, "HELD", 2)

    class Most:
        def seed(self, row):
            return row[0]

        def accumulate(self, state, row):
            return max(state, row[0])

        merge = staticmethod(max)

        def final(self, state):
            return int(state)

    frame = spark.createDataFrame([("a", 1), ("a", 4), (None, 2), ("b", 3), ("c", 9)], "k string, v long").repartition(3)
    got = {r["k"]: r["result"] for r in decompose.aggregate_by(frame, ["k"], ["v"], Most(), "long").collect()}
    assert got == {"a": 4, None: 2, "b": 3, "c": 9}


def test_associative_seed_is_identity(spark):
    d = numbers(spark, 10, 6)
    assert d.associative("x", int, lambda a, b: int(a) + int(b), "long") == 45


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.int_div(F.lit(-7), F.lit(2)).alias("q"), scalar.equal(F.lit(None), F.lit(None)).alias("e"),
        scalar.is_null_or_empty(F.lit("")).alias("n"), scalar.split_on(F.lit("a||b|"), "|").alias("s"),
        scalar.format_pair("{0}: {1}!", F.lit("w"), F.lit(3)).alias("f"), scalar.compare(F.lit(None).cast("int"), F.lit(1)).alias("c"),
    ).first()
    assert tuple(row) == (-3, True, True, ["a", "", "b", ""], "w: 3!", -1)


def test_stores(context, spark, tmp_path):
    d = numbers(spark, 10)
    target = f"{tmp_path}/x.parquet"
    d.write(target, compression="gzip")
    assert context.from_store(target).count() == 10
    with pytest.raises(StoreExists):
        d.write(target)
    d.write(target, replace=True)
    with pytest.raises(DuplicateStore):
        context.submit(d.to_store(f"{tmp_path}/y"), d.to_store(f"{tmp_path}/y"))
    context.submit(d.to_store(f"{tmp_path}/a.json"), d.to_store(f"{tmp_path}/b.csv", header=True))
    assert context.from_store(f"{tmp_path}/a.json").count() == context.from_store(f"{tmp_path}/b.csv", header=True).count() == 10
    with pytest.raises(UnknownScheme):
        context.from_store("nowhere://x")


def test_partitioned_files(context, spark, tmp_path):
    lines = Dataset(spark.createDataFrame([(f"line {k}",) for k in range(9)], "line string").repartition(3))
    uri = f"partfile://{tmp_path}/set.pt"
    lines.write(uri)
    assert os.path.exists(f"{tmp_path}/set.00000002")
    assert sorted(r["line"] for r in context.from_store(uri).frame.collect()) == [f"line {k}" for k in range(9)]
    with pytest.raises(StoreExists):
        lines.write(uri)
    for bad in (["/x"], ["/x", "2", "0,1"], ["/x", "1", "a,1"]):
        with pytest.raises(BadStore):
            read_partfile_index(bad)


def test_serializers_and_providers(context, spark, tmp_path):
    def lines(batches):
        for batch in batches:
            yield pd.DataFrame({"line": batch["x"].map("<{}>".format)})

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame({"x": [int(p[1:-1]) for p in content.decode().split()]})

    numbers(spark, 6).write(f"{tmp_path}/own", serializer=lines)
    assert sorted(values(context.from_store(f"{tmp_path}/own", deserializer=parse, schema="x long"))) == list(range(6))
    register("range", Provider(lambda spark, uri, **_: spark.range(int(uri.split("://")[1])), None, lambda spark, uri: True))
    assert context.from_store("range://4").count() == 4


def test_context(spark):
    with Context(spark) as c:
        assert values(c.from_enumerable([3, 4]), "value") == [3, 4]
    with pytest.raises(Disposed):
        c.from_enumerable([1])
    with pytest.raises(TypeError):
        Context(spark, nonsense=1)


def test_streams(spark, tmp_path):
    frame = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    frame.write.parquet(f"{tmp_path}/in")
    stream = events.event_counts(events.read_folder(spark, f"{tmp_path}/in"))
    events.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    done = spark.read.parquet(f"{tmp_path}/out")
    batch = frame.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("start"), "event_type").count()
    assert done.count() and done.join(batch, ["start", "event_type"]).where("n <> count").count() == 0


def test_positional_plan_has_no_single_partition_window(spark):
    plan = ordering.with_index(spark.range(100).toDF("x"), ["x"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = Dataset(orders).where(F.col("o_totalprice") > 1000).distinct().select("o_orderkey").frame._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan.replace("PushedFilters: [IsNotNull(o_totalprice), ", "")


BIG = 2**53 + 1


class _Count:
    def seed(self, row):
        return 1

    def accumulate(self, state, row):
        return state + 1

    def merge(self, a, b):
        return a + b

    def final(self, state):
        return state


def test_large_null_and_nan_keys_stay_apart(spark):
    rows = [(BIG, 1.0), (BIG - 1, 1.0), (None, float("nan")), (BIG, None), (None, float("nan"))]
    frame = spark.createDataFrame(rows, "k long, d double").coalesce(1)
    assert {r["k"]: r["result"] for r in Dataset(frame).aggregate_by(["k"], ["d"], _Count(), "long").frame.collect()} == {BIG: 2, BIG - 1: 1, None: 2}
    found = Dataset(frame).aggregate_by(["d"], ["k"], _Count(), "long").frame.collect()
    assert sorted((str(r["d"]), r["result"]) for r in found) == [("1.0", 2), ("None", 1), ("nan", 2)]


def test_a_column_of_ones_own_named_idx(spark):
    data = Dataset(spark.createDataFrame([(k, 77 + k) for k in range(6)], "id long, idx long"), ("id",))
    assert [tuple(r) for r in data.skip(4).frame.orderBy("id").collect()] == [(4, 81), (5, 82)]
    assert [r["id"] for r in data.where_indexed(F.col("idx") == 79).frame.collect()] == [2]
    assert sorted(r["id"] for r in data.take_while(F.col("idx") < 80).frame.collect()) == [0, 1, 2]
    pairs = sorted((r["idx"], r["left"]["idx"], r["right"]["idx"]) for r in data.zip(data).skip(4).frame.collect())
    assert pairs == [(4, 81, 81), (5, 82, 82)]
    plain = data.select("id")
    assert plain.with_index().skip(2).frame.columns == ["id", "idx"]
    assert plain.with_index().take_while(F.col("idx") < 2).frame.count() == 2
    assert data.element_at(3)["idx"] == 80 and data.element_at(9, default=True) is None
    with pytest.raises(NameClash):
        data.with_index()


def test_joins_of_a_dataset_with_itself(spark):
    data = Dataset(spark.createDataFrame([(1, 2), (2, 3), (None, 1)], "a long, b long"))
    got = data.join(data, ["a"], ["b"], lambda o, i: [o["a"].alias("x"), i["a"].alias("y")]).frame.collect()
    assert sorted((r["x"], r["y"] or 0) for r in got) == [(1, 0), (2, 1)]


def test_group_join_without_matches(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x", 5)], "j long, t string, v long")
    aggregates = {"orders": F.count("*"), "n_name": F.max("t"), "total": A.sum_of(right, "v"), "raw": F.sum("v")}
    got = Dataset(left).group_join(Dataset(right), ["k"], ["j"], aggregates).order_by("k").frame.collect()
    assert [tuple(r) for r in got] == [(1, 1, "x", 5, 5), (2, 0, None, 0, None)]


def test_order_check_with_nulls(spark):
    rows = Dataset(spark.createDataFrame([(None,), (1,), (2,)], "x long").coalesce(1), ("x",))
    assert rows.check_order_by("x").frame.count() == 3
    with pytest.raises(NotOrdered):
        Dataset(spark.createDataFrame([(1,), (None,)], "x long").coalesce(1), ("x",)).check_order_by("x")


def test_whole_division_of_large_numbers(spark):
    row = spark.range(1).select(scalar.int_div(F.lit(BIG), F.lit(1)).alias("a"), scalar.int_div(F.lit(-7), F.lit(2)).alias("b")).first()
    assert tuple(row) == (BIG, -3)


def test_several_datasets_that_are_empty_or_of_other_types(spark):
    a, b = spark.createDataFrame([], "x long"), spark.createDataFrame([("q", BIG), ("r", None)], "s string, n long")
    sizes = lambda frames: pd.DataFrame({"n": [len(f) for f in frames]})
    assert [r["n"] for r in Dataset(a).apply_many([Dataset(a)], sizes, "n long").frame.collect()] in ([0, 0], [])
    assert sorted(r["n"] for r in Dataset(a).apply_many([Dataset(b)], sizes, "n long").frame.collect()) == [0, 2]
    with pytest.raises(PartitionMismatch):
        Dataset(b.repartition(2)).apply_per_partition_many([Dataset(b.repartition(3))], sizes, "n long")


@pytest.mark.parametrize("most", [0, 200_000])
def test_broadcast_on_both_sides_of_its_bound(spark, monkeypatch, most):
    monkeypatch.setattr(partition, "BROADCAST_ROWS", most)
    monkeypatch.setattr(partition, "BATCH_ROWS", 7)
    data, other = Dataset(spark.range(40).repartition(3)), Dataset(spark.range(5))

    def run(batches, whole):
        yield pd.DataFrame({"n": [sum(len(b) for b in batches) * len(whole)]})

    assert sum(r["n"] for r in data.apply_with_broadcast(other, run, "n long").frame.collect()) == 200


def test_folds_run_lazily_in_one_task(spark):
    data = Dataset(spark.createDataFrame([(k, None if k == 1 else BIG + k) for k in range(4)], "k long, v long"), ("k",))
    assert data.fold("v", list, lambda s, v: [*s, v]) == [BIG, None, BIG + 2, BIG + 3]
    assert data.aggregate_as_query("v", 0, lambda s, v: s + (v or 0), "long").frame.first()["result"] == 3 * BIG + 5


def test_single_fails_on_several_rows(spark):
    data = Dataset(spark.range(3))
    with pytest.raises(Exception, match="MoreThanOne"):
        data.single_as_query().frame.collect()
    assert data.single_as_query(F.col("id") == 1).frame.collect()[0]["id"] == 1


def test_partitions_with_paths_of_their_own():
    assert partfile_paths(["/d/base", "3", "0,5", "10,6,host", "2,7,host:/e/other"]) == ["/d/base.00000000", "/d/base.0000000a", "/e/other"]
