"""Comparing a query's rows with its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def in_duckdb(sql):
    with duckdb.connect() as connection:
        for t in TABLES:
            connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
        cursor = connection.execute(sql)
        columns = [c[0] for c in cursor.description]
        return columns, cursor.fetchall()


def assert_same(frame, sql):
    columns, expected = in_duckdb(sql)
    assert sorted(frame.columns) == sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in expected), key=repr)
