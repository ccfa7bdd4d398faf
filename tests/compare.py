"""Rows of a frame against DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c.sql(sql).df()


def rows(df, columns):
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


def assert_same(found, expected):
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert rows(found, columns) == rows(expected, columns)
