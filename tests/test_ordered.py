"""Ordered operators give the same answers whole, sliced, and walked one by one."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import BASE_US, LAT, LON, make_positions, track
from wayfold.functions.geo import np_haversine_m
from wayfold.operators import fold
from wayfold.operators.client import detect_client_stops
from wayfold.operators.ordered import WHOLE, Slicing, choose_slicing, fill_forward, number_rows
from wayfold.operators.policy import backtest_sampling
from wayfold.operators.route import thin
from wayfold.operators.stops import StopKernel, detect_stops
from wayfold.operators.trips import detect, mark_parked, with_steps
from wayfold.session import materialise

SLICINGS = [WHOLE, Slicing(1_800_000_000), Slicing(307_000_000), 150]
IDS = ["whole", "30min", "307s", "by key"]


def chosen(slicing, df):
    """A number stands for the rows from which a vehicle is cut."""
    return choose_slicing(df, ["vehicle_id"], "recorded_at", slicing) if isinstance(slicing, int) else slicing


def sec(column):
    return ((F.unix_micros(column) - BASE_US) / 1e6).alias(column)


@pytest.mark.parametrize("slicing", SLICINGS, ids=IDS)
def test_stops_and_trips(walks, slicing):
    tracks, df = walks
    trips, stops = detect(df, slicing=chosen(slicing, df))
    got_stops = {(r[0], r[1], r[2]) for r in stops.select("vehicle_id", sec("arrived_at"), sec("departed_at")).collect()}
    want_stops, want_trips = set(), {}
    for v, samples in tracks.items():
        found = brute.stops(samples)
        want_stops |= {(v, a, d) for a, d in found}
        want_trips |= {(v, s, e): m for s, e, m in brute.trips(samples, found)}
    assert got_stops == want_stops
    rows = trips.select("vehicle_id", sec("started_at"), sec("ended_at"), "distance_m").collect()
    assert {(r[0], r[1], r[2]) for r in rows} == set(want_trips)
    for r in rows:
        assert r[3] == pytest.approx(want_trips[r[0], r[1], r[2]], abs=1e-6)

    started = trips.select(F.col("id").alias("trip_id"), sec("started_at"))
    rows = stops.join(started, "trip_id", "left").select("vehicle_id", sec("arrived_at"), "started_at").collect()
    want_links = set()
    for v, samples in tracks.items():
        found = brute.stops(samples)
        want_links |= {(v, f[0], t) for f, t in zip(found, brute.link(found, brute.trips(samples, found)))}
    assert {tuple(r) for r in rows} == want_links


def test_slices_narrower_than_the_dwell(walks):
    tracks, df = walks
    few = df.filter(F.col("vehicle_id").isin("parked", "moving"))
    rows = detect_stops(few, slicing=Slicing(50_000_000)).select("vehicle_id", sec("arrived_at"), sec("departed_at"))
    want = {(v, a, d) for v in ("parked", "moving") for a, d in brute.stops(tracks[v])}
    assert {tuple(r) for r in rows.collect()} == want


@pytest.mark.parametrize("slicing", SLICINGS, ids=IDS)
def test_client_detector(walks, slicing):
    tracks, df = walks
    found = detect_client_stops(df, slicing=chosen(slicing, df))
    rows = found.select("vehicle_id", "kind", sec("arrived_at"), sec("departed_at")).collect()
    want = {(v, *e) for v, samples in tracks.items() for e in brute.client(samples)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("slicing", SLICINGS, ids=IDS)
def test_thinning(walks, slicing):
    tracks, df = walks
    broken = df.withColumn("lat", F.when(F.col("reading_id").endswith("77"), float("nan")).otherwise(F.col("lat")))
    rows = thin(broken, slicing=chosen(slicing, broken)).select("vehicle_id", sec("recorded_at")).collect()
    number, want = 0, set()
    for v, samples in tracks.items():
        marked = []
        for s in samples:
            marked.append((s[0], float("nan") if f"{number:08d}".endswith("77") else s[1], s[2]))
            number += 1
        want |= {(v, t) for t in brute.thin(marked)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("slicing", SLICINGS, ids=IDS)
def test_tier_changes(walks, slicing):
    tracks, df = walks
    df = df.withColumn("motion_state", F.when(F.expr("cast(reading_id as int) div 17 % 3 = 0"), "driving").otherwise("still"))
    df = df.withColumn("battery_pct", (F.expr("cast(reading_id as int) div 29 % 2") * 50 + 10).cast("smallint"))
    rows = backtest_sampling(df, slicing=chosen(slicing, df)).select("vehicle_id", sec("changed_at"), "tier").collect()
    number, want = 0, set()
    for v, samples in tracks.items():
        wanted = []
        for s in samples:
            low = number // 29 % 2 == 0
            wanted.append((s[0], "active" if number // 17 % 3 == 0 else "saver" if low else "idle"))
            number += 1
        want |= {(v, *c) for c in brute.tiers(wanted)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_windows_carry_over_slices(walks):
    _, df = walks
    marked = df.withColumn("mark", F.when(F.col("reading_id").endswith("3"), F.col("reading_id")))
    order = ["recorded_at", "reading_id"]
    for build in (
        lambda s: number_rows(df, ["vehicle_id"], "recorded_at", order, s).select("reading_id", "rn"),
        lambda s: fill_forward(marked, ["vehicle_id"], "recorded_at", order, "mark", s, "seen").select("reading_id", "seen"),
        lambda s: with_steps(df, s).select("reading_id", "gap_seconds", F.round("step_m", 6)),
    ):
        want = {tuple(r) for r in build(WHOLE).collect()}
        for slicing in SLICINGS[1:]:
            assert {tuple(r) for r in build(chosen(slicing, df)).collect()} == want


def test_busy_vehicles_are_cut_by_their_own_rows(walks):
    _, df = walks
    assert choose_slicing(df, ["vehicle_id"], "recorded_at", 10_000) == WHOLE
    cut = choose_slicing(df, ["vehicle_id"], "recorded_at", 310)
    sliced = cut.attach(df, ["vehicle_id"], "recorded_at")
    sizes = {v: sorted(r["count"] for r in rows) for v, rows in groups(sliced.groupBy("vehicle_id", "_slice").count().collect(), "vehicle_id").items()}
    tracks, _ = walks
    for v, samples in tracks.items():
        assert sum(sizes[v]) == len(samples)
        if len(samples) <= 310:
            assert sizes[v] == [len(samples)]
        else:
            assert max(sizes[v]) <= 320 and len(sizes[v]) <= 2 * len(samples) / 310 + 3


def groups(rows, name):
    out = {}
    for r in rows:
        out.setdefault(r[name], []).append(r)
    return out


def test_a_dense_vehicle_is_cut_within_a_second(spark):
    rows = [("v", k / 50, LAT, LON) for k in range(500)] + [("w", float(k), LAT, LON) for k in range(20)]
    cut = choose_slicing(make_positions(spark, rows), ["vehicle_id"], "recorded_at", 100)
    sliced = cut.attach(make_positions(spark, rows), ["vehicle_id"], "recorded_at").groupBy("vehicle_id", "_slice").count().collect()
    assert sorted(r["count"] for r in sliced if r.vehicle_id == "v") == [100] * 5
    assert [r["count"] for r in sliced if r.vehicle_id == "w"] == [20]


def test_result_does_not_depend_on_partitioning(walks):
    _, df = walks
    a = detect_stops(df.coalesce(1), slicing=WHOLE)
    b = detect_stops(df.repartition(7), slicing=Slicing(300_000_000))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


CASES = {
    "simple stop": ([(30 * i, 0) for i in range(11)], 1, 0),
    "brief pause": ([(0, 0), (30, 300), (60, 600), (90, 605), (120, 610), (150, 900), (180, 1200)], 0, 1),
    "slow creep": ([(30 * i, 20 * i) for i in range(21)], 0, 1),
    "coverage gap": (
        [(0, 0), (30, 400), (60, 800), (1860, 40000), (1890, 40400), (1920, 40800)], 0, 2,
    ),
    "stop between trips": (
        [(0, 0), (30, 400), (60, 800), *[(90 + 30 * i, 1000) for i in range(11)], (420, 1400), (450, 1800), (480, 2200)],
        1, 2,
    ),
    "one sample": ([(0, 0)], 0, 0),
}


@pytest.mark.parametrize("name", CASES)
def test_literal_tracks(spark, name):
    samples, n_stops, n_trips = CASES[name]
    trips, stops = detect(track(spark, samples), slicing=WHOLE)
    assert (stops.count(), trips.count()) == (n_stops, n_trips)
    if name == "coverage gap":
        assert trips.agg(F.max("distance_m")).first()[0] < 1000
    if name == "simple stop":
        assert stops.first()["departed_at"] is None


@pytest.mark.parametrize("slicing", [None, WHOLE, Slicing(60_000_000)], ids=["measured", "whole", "sliced"])
def test_no_positions(spark, slicing):
    none = track(spark, [(0, 0)]).filter("false")
    trips, stops = detect(none, slicing=slicing)
    assert (trips.count(), stops.count()) == (0, 0)
    assert detect_client_stops(none, slicing=slicing).count() == 0


def test_silent_parked_vehicle_is_one_stop_over_empty_slices(spark):
    samples = [(0, 0), (30, 0), (60, 0), (90, 0), (120, 0), (90_000, 3), (180_000, 5), (180_030, 900), (180_060, 1800)]
    for slicing in (WHOLE, Slicing(3_600_000_000)):
        trips, stops = detect(track(spark, samples), slicing=slicing)
        rows = stops.select(sec("arrived_at"), sec("departed_at")).collect()
        assert [tuple(r) for r in rows] == [(0, 180_000)]
        assert [tuple(r) for r in trips.select(sec("started_at"), sec("ended_at")).collect()] == [(180_030, 180_060)]


def test_passes_do_not_grow_with_slices(spark, monkeypatch):
    """One vehicle parked all day on a wide lot: its box exceeds the radius, and now and then it leaves the anchor's circle."""
    rng = np.random.default_rng(3)
    samples = [("v", 10.0 * k, LAT + rng.normal(0, 14) / 111_320, LON + rng.normal(0, 14) / 73_000) for k in range(4320)]
    df = make_positions(spark, samples).cache()
    passes = []
    monkeypatch.setattr(fold, "materialise", lambda rows: passes.append(1) or materialise(rows))
    want = None
    for slices in (1, 6, 24):
        passes.clear()
        rows = detect_stops(df, slicing=Slicing(43_200_000_000 // slices)).select(sec("arrived_at"), sec("departed_at"))
        found = {tuple(r) for r in rows.collect()}
        assert len(passes) == 3
        want = want or set(brute.stops([(s, a, b) for _, s, a, b in samples]))
        assert found == want and len(want) > 3


def test_dense_rows_take_seconds():
    """Half a million samples within minutes, most of them within the radius of any other."""
    rng, n = np.random.default_rng(5), 500_000
    us = np.arange(n, dtype=np.int64) * 1000
    lat, lon = LAT + rng.normal(0, 8, n) / 111_320, LON + rng.normal(0, 8, n) / 73_000
    kernel, started = StopKernel(50.0, 120_000_000), time.process_time()
    state, out = kernel.run(None, {"_us": us, "lat": lat, "lon": lon})
    assert time.process_time() - started < 60
    at, found = 0, []
    while at < n:  # the plain walk; a run that leaves early costs little, a long one is a stop
        far = np.flatnonzero(np_haversine_m(lat[at], lon[at], lat[at + 1 :], lon[at + 1 :]) > 50.0)
        end = at + 1 + int(far[0]) if len(far) else n
        if us[end - 1] - us[at] >= 120_000_000:
            found.append((int(us[at]), int(us[end - 1])))
            at = end
        elif end == n:
            break
        else:
            at += 1
    stop = [(state["stop"][2], state["last"])] if state and "stop" in state else []
    assert list(zip(out["arrived_us"], out["departed_us"])) + stop == found


def test_span_rows_do_not_grow_with_a_stop(spark):
    """A stop of a week over hourly slices is one row among the samples."""
    samples = [(0, 0), *[(3600 * k, 1) for k in range(1, 168)], (604_900, 900), (604_930, 1800)]
    df = track(spark, samples)
    stops = detect_stops(df, slicing=Slicing(3_600_000_000))
    rows = mark_parked(df, stops, Slicing(3_600_000_000))
    assert "explode" not in rows._jdf.queryExecution().toString().lower()
    assert rows.filter("parked").count() == 168 and rows.count() == 170
