"""Every registered query of the library's own operators against its SQL twin, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from skylattice import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert got == rows
