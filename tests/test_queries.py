"""Every query equals its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from meshobs.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in result.fetchall())
    assert got == want


def test_entry():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())
