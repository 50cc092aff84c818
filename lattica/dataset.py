"""The fluent API: a DataFrame with the order that positional operators use."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.errors import OrderRequired
from lattica.operators import aggregates as A
from lattica.operators import decompose, ordering, partition, relational, window
from lattica.sources.stores import Write, submit


class Dataset:
    """An immutable, lazy collection of rows."""

    def __init__(self, frame: DataFrame, order: Sequence = ()):
        self.frame, self.order = frame, tuple(order)

    def _with(self, frame: DataFrame) -> Dataset:
        """A result whose rows keep the order, as far as its columns have the keys."""
        kept = all(not isinstance(k, str) or k in frame.columns for k in self.order)
        return Dataset(frame, self.order if kept else ())

    def ordered_by(self, *keys) -> Dataset:
        """Names the total order of the rows, without sorting them."""
        return Dataset(self.frame, keys)

    # Projection and filters
    def select(self, *columns) -> Dataset:
        return self._with(self.frame.select(*columns))

    def where(self, predicate: Column) -> Dataset:
        return self._with(self.frame.where(predicate))

    def select_indexed(self, *columns) -> Dataset:
        return self._with(relational.select_indexed(self.frame, self.order, *columns))

    def where_indexed(self, predicate: Column) -> Dataset:
        return self._with(relational.where_indexed(self.frame, self.order, predicate))

    def select_many(self, items: Column, name: str = "item", keep: Sequence[str] | None = None) -> Dataset:
        return Dataset(relational.select_many(self.frame, items, name, keep))  # items of a row have no order yet

    def select_many_indexed(self, items: Column, name: str = "item", keep: Sequence[str] | None = None) -> Dataset:
        return Dataset(relational.select_many_indexed(self.frame, self.order, items, name, keep))

    # Joins and set operations
    def join(self, other: Dataset, left_keys, right_keys, result: Callable | None = None, null_safe: bool = True, how: str = "inner") -> Dataset:
        return Dataset(relational.join(self.frame, other.frame, left_keys, right_keys, result, null_safe, how))

    def group_join(self, other: Dataset, left_keys, right_keys, aggregates=None, null_safe: bool = True) -> Dataset:
        return self._with(relational.group_join(self.frame, other.frame, left_keys, right_keys, aggregates, null_safe))

    def semi_join(self, other: Dataset, left_keys, right_keys, null_safe: bool = True) -> Dataset:
        return self._with(relational.semi(self.frame, other.frame, left_keys, right_keys, null_safe))

    def anti_join(self, other: Dataset, left_keys, right_keys, null_safe: bool = True) -> Dataset:
        return self._with(relational.anti(self.frame, other.frame, left_keys, right_keys, null_safe))

    def cross_product(self, other: Dataset, predicate: Column | None = None, result: Callable | None = None) -> Dataset:
        return Dataset(relational.cross_product(self.frame, other.frame, predicate, result))

    def concat(self, *others: Dataset) -> Dataset:
        return Dataset(relational.concat(self.frame, *[o.frame for o in others]))

    def union(self, other: Dataset, key: Column | None = None) -> Dataset:
        return Dataset(relational.union(self.frame, other.frame, key))

    def intersect(self, other: Dataset, key=None) -> Dataset:
        return Dataset(relational.intersect(self.frame, other.frame, key))

    def except_(self, other: Dataset, key=None) -> Dataset:
        return Dataset(relational.except_(self.frame, other.frame, key))

    def distinct(self, key: Column | None = None, prefer: Column | None = None) -> Dataset:
        return self._with(relational.distinct(self.frame, key, prefer))

    # Groups and aggregates
    def group_by(self, *keys, aggregates: dict[str, Column] | None = None, element: Column | None = None) -> Dataset:
        return Dataset(A.group_by(self.frame, keys, aggregates, element))

    def map_reduce(self, items: Column, key: Callable, aggregates: dict[str, Column]) -> Dataset:
        return Dataset(A.map_reduce(self.frame, items, key, aggregates))

    def aggregate_by(self, keys, columns, udaf, kind: str, name: str = "result") -> Dataset:
        return Dataset(decompose.aggregate_by(self.frame, keys, columns, udaf, kind, name))

    def fold(self, column: str, seed, step, result=lambda a: a):
        return decompose.fold(self.frame, self._order(), column, seed, step, result)

    def aggregate_as_query(self, column: str, seed, step, kind: str, result=lambda a: a) -> Dataset:
        return Dataset(decompose.fold_as_query(self.frame, self._order(), column, seed, step, kind, result))

    def associative(self, column: str, seed, merge, kind: str):
        return A.value(decompose.associative(self.frame, column, seed, merge, kind))

    def associative_as_query(self, column: str, seed, merge, kind: str) -> Dataset:
        return Dataset(decompose.associative(self.frame, column, seed, merge, kind))

    def count_as_query(self, predicate: Column | None = None) -> Dataset:
        return Dataset(A.count_as_query(self.frame, predicate))

    def long_count_as_query(self, predicate: Column | None = None) -> Dataset:
        return Dataset(A.count_as_query(self.frame, predicate, small=False))

    def sum_as_query(self, column) -> Dataset:
        return Dataset(A.sum_as_query(self.frame, column))

    def min_as_query(self, column, strict: bool = False) -> Dataset:
        return Dataset(A.min_as_query(self.frame, column, strict))

    def max_as_query(self, column, strict: bool = False) -> Dataset:
        return Dataset(A.max_as_query(self.frame, column, strict))

    def average_as_query(self, column, strict: bool = False) -> Dataset:
        return Dataset(A.average_as_query(self.frame, column, strict))

    def any_as_query(self, predicate: Column | None = None) -> Dataset:
        return Dataset(A.any_as_query(self.frame, predicate))

    def all_as_query(self, predicate: Column) -> Dataset:
        return Dataset(A.all_as_query(self.frame, predicate))

    def contains_as_query(self, column: str, value, normal=lambda c: c) -> Dataset:
        return Dataset(A.contains_as_query(self.frame, column, value, normal))

    def first_as_query(self, predicate: Column | None = None) -> Dataset:
        return Dataset(A.first_as_query(self.frame, self._order(), predicate))

    def last_as_query(self, predicate: Column | None = None, opposite: Sequence | None = None) -> Dataset:
        return Dataset(A.last_as_query(self.frame, opposite or ordering.reversed_keys(self._order()), predicate))

    def single_as_query(self, predicate: Column | None = None) -> Dataset:
        return Dataset(A.single_as_query(self.frame, predicate))

    def count(self, predicate: Column | None = None) -> int:
        return A.value(A.count_as_query(self.frame, predicate))

    def long_count(self, predicate: Column | None = None) -> int:
        return A.value(A.count_as_query(self.frame, predicate, small=False))

    def sum(self, column):
        return A.value(A.sum_as_query(self.frame, column))

    def min(self, column, strict: bool = False):
        return A.value(A.min_as_query(self.frame, column, strict))

    def max(self, column, strict: bool = False):
        return A.value(A.max_as_query(self.frame, column, strict))

    def average(self, column, strict: bool = False):
        return A.value(A.average_as_query(self.frame, column, strict))

    def any(self, predicate: Column | None = None) -> bool:
        return A.value(A.any_as_query(self.frame, predicate))

    def all(self, predicate: Column) -> bool:
        return A.value(A.all_as_query(self.frame, predicate))

    def contains(self, column: str, value, normal=lambda c: c) -> bool:
        return A.value(A.contains_as_query(self.frame, column, value, normal))

    def first(self, predicate: Column | None = None, default: bool = False):
        return A.one(self.first_as_query(predicate).frame, default)

    def last(self, predicate: Column | None = None, default: bool = False, opposite: Sequence | None = None):
        return A.one(self.last_as_query(predicate, opposite).frame, default)

    def single(self, predicate: Column | None = None, default: bool = False):
        return A.one(self.single_as_query(predicate).frame, default, single=True)

    # Order and position
    def _order(self) -> tuple:
        if not self.order:
            raise OrderRequired("name an order with ordered_by() or order_by()")
        return self.order

    def order_by(self, *keys) -> Dataset:
        return Dataset(self.frame.orderBy(*keys), keys)

    def with_index(self, name: str = "idx") -> Dataset:
        return self._with(ordering.with_index(self.frame, self.order, name))

    def take(self, count: int) -> Dataset:
        return self._with(ordering.take(self.frame, self.order, count))

    def skip(self, count: int) -> Dataset:
        return self._with(ordering.skip(self.frame, self.order, count))

    def take_while(self, predicate: Column) -> Dataset:
        return self._with(ordering.take_while(self.frame, self.order, predicate))

    def skip_while(self, predicate: Column) -> Dataset:
        return self._with(ordering.skip_while(self.frame, self.order, predicate))

    def element_at(self, place: int, default: bool = False):
        return A.one(ordering.element_at(self.frame, self._order(), place), default)

    def reverse(self, opposite: Sequence | None = None) -> Dataset:
        keys = opposite or ordering.reversed_keys(self._order())
        return Dataset(ordering.reverse(self.frame, self.order, keys), keys)

    def zip(self, other: Dataset) -> Dataset:
        return Dataset(ordering.zip_with(self.frame, self.order, other.frame, other.order), ("idx",))

    def sequence_equal_as_query(self, other: Dataset) -> Dataset:
        return Dataset(ordering.sequence_equal(self.frame, self.order, other.frame, other.order))

    def sequence_equal(self, other: Dataset) -> bool:
        return A.value(self.sequence_equal_as_query(other).frame)

    def check_order_by(self, *keys) -> Dataset:
        return self._with(ordering.check_order_by(self.frame, keys or self.order))

    def sliding_window(self, size: int, results: dict[str, Column] | None = None, apply=None) -> Dataset:
        return Dataset(window.sliding_window(self.frame, self.order, size, results, apply), ("idx",))

    # Partitions
    def hash_partition(self, *keys, count: int | None = None, result: Sequence | None = None) -> Dataset:
        return self._with(partition.hash_partition(self.frame, keys, count, result))

    def range_partition(self, *keys, count: int | None = None, separators: Sequence | None = None, descending: bool = False) -> Dataset:
        if separators is not None:
            key = F.col(keys[0]) if isinstance(keys[0], str) else keys[0]
            return self._with(partition.range_partition_by(self.frame, key, separators, descending))
        if descending:
            keys = tuple(F.col(k).desc() if isinstance(k, str) else k for k in keys)
        return self._with(partition.range_partition(self.frame, keys, count))

    def assume_hash_partition(self, *keys) -> Dataset:
        return self

    def assume_range_partition(self, *keys, separators: Sequence | None = None, count: int | None = None) -> Dataset:
        return self._with(partition.assume_partition(self.frame, separators, count))

    def assume_order_by(self, *keys) -> Dataset:
        return Dataset(self.frame, keys)

    def apply(self, function, schema: str) -> Dataset:
        return Dataset(partition.apply_whole(self.frame, function, schema, self.order))

    def apply_binary(self, other: Dataset, function, schema: str) -> Dataset:
        return Dataset(partition.apply_binary_whole(self.frame, other.frame, function, schema))

    def apply_many(self, others: Sequence[Dataset], function, schema: str) -> Dataset:
        return Dataset(partition.apply_many([self.frame, *[o.frame for o in others]], function, schema))

    def apply_per_partition(self, function, schema: str) -> Dataset:
        return Dataset(partition.apply_per_partition(self.frame, function, schema))

    def apply_pairwise(self, other: Dataset, function, schema: str) -> Dataset:
        return Dataset(partition.apply_pairwise(self.frame, other.frame, function, schema))

    def apply_per_partition_many(self, others: Sequence[Dataset], function, schema: str) -> Dataset:
        return Dataset(partition.apply_per_partition_many([self.frame, *[o.frame for o in others]], function, schema))

    def apply_with_broadcast(self, other: Dataset, function, schema: str) -> Dataset:
        return Dataset(partition.apply_with_broadcast(self.frame, other.frame, function, schema))

    def apply_with_partition_index(self, function, schema: str) -> Dataset:
        return Dataset(partition.apply_with_partition_index(self.frame, function, schema))

    def broadcast_copies(self, count: int) -> Dataset:
        return Dataset(partition.broadcast_copies(self.frame, count))

    def fork(self, **branches: Column) -> partition.Forked:
        return partition.fork(self.frame, **branches)

    def fork_per_partition(self, function, schemas: dict[str, str]) -> partition.Forked:
        return partition.fork_per_partition(self.frame, function, schemas)

    def fork_by_key(self, key: Column, keys: Sequence) -> partition.Forked:
        return partition.fork_by_key(self.frame, key, keys)

    def do_while(self, body: Callable[[Dataset], Dataset], condition: Callable[[Dataset, Dataset], bool], count: int = 1, most: int = 1000) -> Dataset:
        def wrapped(frame: DataFrame) -> DataFrame:
            return body(self._with(frame)).frame

        def test(before: DataFrame, after: DataFrame) -> bool:
            return condition(self._with(before), self._with(after))

        return self._with(partition.do_while(self.frame, wrapped, test, count, most))

    # Output
    def to_store(self, uri: str, replace: bool = False, **options) -> Write:
        """A prepared write; submit() runs one or several."""
        return Write(self.frame, uri, replace, options)

    def write(self, uri: str, replace: bool = False, **options) -> None:
        submit(self.frame.sparkSession, [self.to_store(uri, replace, **options)]).wait()

    def __iter__(self):
        return (self.frame.orderBy(*self.order) if self.order else self.frame).toLocalIterator()

    def explain(self) -> None:
        self.frame.explain("formatted")
