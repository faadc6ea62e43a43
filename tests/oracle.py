"""Compares a Spark result with DuckDB's on the same tables, whatever the order of rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None or v != v:
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def check(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
