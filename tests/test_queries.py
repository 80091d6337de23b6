"""Each registered query against its SQL, over the smallest tables."""

import datetime
import os

import duckdb
import pytest

from loomtrace.plans import all_queries
from loomtrace.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in got.collect())
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
        assert sorted(names) == cols and rows == want


def test_flagship(spark):
    got = all_queries.flagship(spark, SF).collect()
    assert got and max(r["rank"] for r in got) == 10
