"""Compare registered queries with their SQL: python -m harness.check [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

from harness.oracle import SQL
from harness.registry import QUERIES
from spendscope.session import build_session

TABLES = "region nation customer supplier part orders lineitem".split()


KINDS = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "date": "DATE", "int": "INTEGER", "boolean": "BOOLEAN"}


def same_types(df: DataFrame, description: list[tuple]) -> bool:
    """Whether both results have the same columns of the same types."""
    return {c: KINDS[kind] for c, kind in df.dtypes} == {d[0]: str(d[1]) for d in description}


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(None if row[i] != row[i] else row[i] for i in order) for row in rows)


def main(sf_dir: str = "/root/testdata/sf0.01", *only: str) -> int:
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    bad = 0
    for name in only or QUERIES:
        start = time.time()
        df = QUERIES[name](spark, sf_dir)
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        took = time.time() - start
        if name not in SQL:
            print(f"{name:32} {sum(got.values()):7} rows {took:6.2f}s  no SQL", flush=True)
            continue
        start = time.time()
        result = db.execute(SQL[name])
        columns = [x[0] for x in result.description]
        want = rows_of(columns, result.fetchall())
        same = got == want and same_types(df, result.description)
        bad += not same
        print(f"{name:32} {sum(got.values()):7} rows {took:6.2f}s  sql {time.time() - start:5.2f}s  "
              f"{'ok' if same else 'DIFFERENT'}", flush=True)
        if not same:
            print("   types", sorted(df.dtypes), sorted((d[0], str(d[1])) for d in result.description))
            for side, extra in (("spark", got - want), ("sql", want - got)):
                print("  ", side, sum(extra.values()), list(extra)[:2])
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
