"""Every query with SQL gives that SQL's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tallgrass.plans import catalog, catalog2, catalog3, catalog4, catalog5  # noqa: F401


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, con):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        return
    ran = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in ran.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, abs=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y
