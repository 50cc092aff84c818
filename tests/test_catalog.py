"""Every query of the catalogue that has SQL, against DuckDB over the same files."""

import duckdb
import pytest

from lattica.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents".split()
SQL = catalog.oracle_sql()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return connection


def plain(value):
    return round(value, 6) if isinstance(value, float) else str(value) if value is not None and not isinstance(value, (int, bool)) else value


def rows(found, columns, names):
    order = [columns.index(n) for n in names]
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    ours = catalog.queries()[name](spark, SMALL)
    theirs = duck.execute(SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    names = sorted(columns)
    assert rows(ours.collect(), ours.columns, names) == rows(theirs.fetchall(), columns, names)


def test_words_of_every_document(spark, duck):
    words = catalog.queries()["select_many_words"](spark, SMALL)
    assert words.select("doc_id").distinct().count() == duck.execute("select count(*) from documents").fetchone()[0]


def test_items_of_every_event(spark, duck):
    items = catalog.queries()["select_many_indexed_whole"](spark, SMALL)
    assert items.count() == 2 * duck.execute("select count(*) from events").fetchone()[0]
