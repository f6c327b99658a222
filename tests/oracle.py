"""Runs a query and its DuckDB oracle on the same tables and compares rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, ([_plain(v) for v in row] for row in zip(*(table.column(n).to_pylist() for n in names)))))


def _plain(value):
    return round(value, 12) if isinstance(value, float) and math.isfinite(value) else value


def expected(sql, sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.sql(sql).to_arrow_table()


def assert_same(df, sql, sf_dir):
    assert rows_of(df.toArrow()) == rows_of(expected(sql, sf_dir))
