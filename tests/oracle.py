"""Comparison of a query with its DuckDB twin: same columns, same rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns, rows):
    order = sorted(columns)
    return sorted(repr(tuple(plain(row[columns.index(c)]) for c in order)) for row in rows)


def assert_same(df, sql, folder):
    found = connect(folder).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = rows_of(columns, found.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == expected
    return len(expected)
