"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from relatrix.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in registry.TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = Counter(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in registry.ORACLES:
        r = duck.execute(registry.ORACLES[name])
        cols = [d[0] for d in r.description]
        assert sorted(cols) == sorted(df.columns)
        by = [cols.index(c) for c in sorted(cols)]
        assert got == Counter(str([plain(row[i]) for i in by]) for row in r.fetchall())
