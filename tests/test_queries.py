"""Every registered query of the voxel engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from voxquarry.plans import more, registry, relational, worlds  # noqa: F401

DATA = os.environ.get("VOXQUARRY_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in registry.ORACLES:
        assert got
        return
    want = sql.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    assert sorted(repr(plain([r[c] for c in columns])) for r in got) == sorted(repr(plain([r[i] for i in at])) for r in want.fetchall())
