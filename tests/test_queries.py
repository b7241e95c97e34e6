"""Every registered query against its SQL, on the smallest data."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CORE = {name: sql for module in entry.modules(entry.CORE) for name, sql in module.ORACLES.items()}
RUN_ONLY = [name for module in entry.modules(entry.CORE) for name in module.QUERIES if name not in CORE]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(df):
    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return str(list(v))
        if v is None or pd.isna(v):
            return "null"
        return f"{float(v):.5f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, sql, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), sql.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(RUN_ONLY))
def test_query_runs(spark, name):
    entry.queries()[name](spark, FOLDER).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["b1_recent_events", "b2_around", "d4_voice_stats", "d5_touch_stats", "d6_scorecard", "d8_timeline_counts", "j10_timeline", "j13_hot_words", "d18_profile_titles"])
def test_bounds_reach_the_scan_before_deliveries_meet(spark, name, capsys):
    entry.queries()[name](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(timestamp" in pushed and "In(modality" in pushed
    assert "hashpartitioning(event_id" in plan
    if name in ("b1_recent_events", "b2_around", "d6_scorecard", "d8_timeline_counts", "d18_profile_titles"):
        assert "payload" not in plan
