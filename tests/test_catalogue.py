"""Every registered query against its SQL twin, compared as the driver does: names, row counts and values in any order."""

import math
from collections import Counter

import duckdb
import pytest

from loomwork.plans.catalogue import registry
from loomwork.plans.sql import TABLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    if isinstance(v, int):
        return float(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries))
def test_query(spark, duck, name):
    df = registry.queries[name](spark, SF)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.sql:
        assert rows
        return
    got = duck.execute(registry.sql[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())
    assert sum(rows.values()) == sum(want.values())
    assert rows == want
