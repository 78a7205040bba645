"""Queries against the SQL oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from wayfold import catalog, fixtures
from wayfold.operators.ordered import Slicing

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: query for name, query in contract.queries().items() if name in catalog.QUERIES}
ORACLE = {name: sql for name, sql in contract.oracle_sql().items() if name in QUERIES}
# The others are covered at a larger scale by the driver; CATALOG_ALL=1 runs them here too.
CORE = (
    "trip_report stop_matches reconciliation_summary client_stop_table route_thinning active_days "
    "position_pages client_stop_merge reading_validation sampling_backtest delivery_plan telemetry_batches "
    "cut_stop_detection cut_trip_detection contested_matches window_resolution ingest_streams"
).split()
CHOSEN = sorted(QUERIES) if os.environ.get("CATALOG_ALL") else CORE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def plain(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


def compare(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in cursor.fetchall())
    got = sorted(repr([plain(v) for v in row]) for row in df.select(*columns).collect())
    assert got == want and got


present = pytest.mark.skipif(not os.path.exists(SF), reason="tables not present")


@present
@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, duck, name):
    compare(spark, duck, name)


@present
@pytest.mark.parametrize(
    "name", "arriving_trip client_stop_table route_thinning sampling_backtest sample_steps battery_drain batch_building".split()
)
def test_against_sql_when_vehicles_are_sliced(spark, duck, name, monkeypatch):
    """As the queries would run if one vehicle were too large for a task."""
    widths = {"events": Slicing(7 * 86_400_000_000), "positions": Slicing(900_000_000)}
    monkeypatch.setattr(fixtures, "_sized", lambda kind, *rest: widths[kind])
    compare(spark, duck, name)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
