"""Queries over tables with the keys of larger ones, against their SQL."""

import os
import shutil

import duckdb
import pytest

from meshobs.plans import registry

from test_queries import SF, TABLES, plain


@pytest.fixture
def equals_sql(spark, tmp_path):
    """A check of a query over the smallest tables, of which ``select`` makes the events."""

    def check(name: str, select: str):
        con = duckdb.connect()
        for t in TABLES:
            if t != "events":
                shutil.copy(f"{SF}/{t}.parquet", tmp_path)
        con.execute(f"COPY (SELECT * REPLACE ({select}) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(tmp_path, t)}.parquet'")
        result = con.execute(registry.ORACLES[name])
        order = sorted(d[0] for d in result.description)
        at = [[d[0] for d in result.description].index(c) for c in order]
        want = sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())
        got = sorted(repr([plain(r[c]) for c in order]) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == want and got

    return check


def test_positions_of_large_ids(equals_sql):
    equals_sql("a24_fold_nodes", "event_id + 4000000 AS event_id")


def test_scopes_of_one_code(equals_sql):
    """Packet 114536 is among the 250: the keys of two scopes give it one code."""
    equals_sql("j7_match_scope", "event_id + 4 * 114500 AS event_id")
