"""Registered queries beside their DuckDB SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import TABLES, rows_of  # noqa: E402
from tarnwatch import registry  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    mine = rows_of(df.columns, df.collect())
    if name in registry.ORACLE_SQL:
        cur = con.execute(registry.ORACLE_SQL[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert mine == rows_of(cols, cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
