"""Comparison of a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb


def _rows(names, rows):
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([fix(r[i]) for i in order]) for r in rows)


def same(spark, query, sql, folder):
    df = query(spark, folder)
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(want.columns, want.fetchall())
