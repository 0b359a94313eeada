"""Every registered query against its SQL on the smallest given tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from harness import check, mapping
from harness.oracle import SQL
from harness.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    # the training-data operators may be absent, and not all of them can be told in SQL
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert check.same_types(df, result.description)
    assert got == check.rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_given_foreign_keys_are_complete(spark):
    for child, key, parent, target in [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ]:
        left, right = mapping._table(spark, SF, child), mapping._table(spark, SF, parent)
        assert left.join(right, left[key] == right[target], "left_anti").isEmpty(), child
