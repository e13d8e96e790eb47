"""Compares a query with its DuckDB text on one folder of tables."""

import glob
import math
import os

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}") if math.isfinite(v) else str(v)
        return v

    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = rows_of(names, con.fetchall())
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:2]
    return got
