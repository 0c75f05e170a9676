"""Runs a statement in DuckDB on the tables of a folder and compares it with a DataFrame, order aside."""

import glob
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def compare(df, statement, con):
    got_cols = sorted(df.columns)
    want = con.execute(statement)
    want_cols = sorted(d[0] for d in want.description)
    assert got_cols == want_cols, (got_cols, want_cols)
    at = [[d[0] for d in want.description].index(c) for c in want_cols]
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    b = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
    a = sorted((tuple(norm(r[c]) for c in got_cols) for r in df.collect()), key=repr)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y, (x, y)
