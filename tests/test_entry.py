"""Driver contract: entry() runs; every registered query runs on sf0.001 and, where
an oracle exists, equals DuckDB on the same tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import digest  # noqa: E402
from deskpass.sources.tables import TABLES  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["category", "decision", "n", "share"]
    assert rows


def test_oracles_are_for_registered_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert len(ORACLE) >= 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert len(cols) == len(set(cols))
        return
    rel = duck.sql(ORACLE[name])
    assert sorted(cols) == sorted(rel.columns)
    orows = rel.fetchall()
    assert len(rows) == len(orows)
    assert digest(cols, rows)[0] == digest(rel.columns, orows)[0]
