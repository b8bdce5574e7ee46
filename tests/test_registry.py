"""Every registered query against its SQL on the smallest data set."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from catalog.oracles import ORACLES
from catalog.queries import REGISTRY
from tools.check import canonical

# Learning is sequential and has no SQL form; tests/test_learning.py replays it instead.
WITHOUT_SQL = {
    "q_walkforward",
    "q_grid_winner",
    "q_light_calibration",
    "q_online_forecast",
    "q_online_forecast_h30",
    "q_stream_forecast",
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SMOKE_DIR):
        name = f.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{f}')")
    return con


def test_only_learning_lacks_sql():
    assert set(REGISTRY) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(REGISTRY)


def test_all_queries_are_handed_out():
    assert REGISTRY.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = REGISTRY[name](spark, SMOKE_DIR).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert len(entry(spark).columns) == 40
