import random

import pytest
from pyspark.sql import functions as F

from conftest import BASE_US, LAT, LON, at, place
from wayfold.operators.reconcile import (
    agreement,
    all_stops,
    greedy_match,
    match_candidates,
    reconcile,
    reconciliation_summary,
    unmatched,
)

STOP = "id string, vehicle_id string, source string, arrived_at timestamp, departed_at timestamp, lat double, lon double"


def stops(spark, source, marks, vehicle="v"):
    """marks: (seconds, metres north)."""
    rows = [(f"{source[0]}{i}", vehicle, source, at(s), None, place(m), LON) for i, (s, m) in enumerate(marks)]
    return spark.createDataFrame(rows, STOP)


def pairs(matches):
    return {(r["client_event_id"], r["derived_event_id"]) for r in matches.collect()}


def test_delta_is_client_minus_derived(spark):
    row = reconcile(stops(spark, "client", [(0, 0)]), stops(spark, "derived", [(40, 20)])).first()
    assert row["delta_seconds"] == -40
    assert row["delta_meters"] == pytest.approx(20, abs=0.1)


def test_tolerances_are_inclusive(spark):
    marks = [(10, 10), (120, 10), (121, 10), (10, 99.9), (10, 150), (5, 500), (10_800, 5)]
    got = []
    for mark in marks:
        found = match_candidates(stops(spark, "client", [(0, 0)]), stops(spark, "derived", [mark]))
        got.append(found.count() == 1)
    assert got == [True, True, False, True, False, False, False]


def test_each_stop_is_matched_once_and_closest_first(spark):
    one = reconcile(stops(spark, "client", [(0, 0), (30, 0)]), stops(spark, "derived", [(5, 0)]))
    assert pairs(one) == {("c0", "d0")}
    two = reconcile(stops(spark, "client", [(0, 0), (90, 10)]), stops(spark, "derived", [(95, 12), (5, 2)]))
    assert pairs(two) == {("c0", "d1"), ("c1", "d0")}


def test_no_stops_on_one_side(spark):
    none = stops(spark, "client", [(0, 0)]).filter("false")
    assert reconcile(none, stops(spark, "derived", [(0, 0)])).count() == 0


def test_other_vehicles_never_match(spark):
    assert reconcile(stops(spark, "client", [(0, 0)], "a"), stops(spark, "derived", [(0, 0)], "b")).count() == 0


def test_rounds_equal_the_sequential_rule(spark):
    """Random candidate graphs with many tied scores."""
    rng = random.Random(3)
    rows, want = [], set()
    for v in range(60):
        n, cands = rng.randint(1, 9), []
        for c in range(n):
            for d in range(n):
                if rng.random() < 0.5:
                    cands.append((rng.choice([0.1, 0.2, 0.3]), c, d))
        taken_c, taken_d = set(), set()
        for score, c, d in sorted(cands):
            if c not in taken_c and d not in taken_d:
                taken_c.add(c)
                taken_d.add(d)
                want.add((f"{v}c{c}", f"{v}d{d}"))
        rows += [(str(v), f"{v}c{c}", f"{v}d{d}", c, d, 0, 0.0, s) for s, c, d in cands]
    rng.shuffle(rows)
    df = spark.createDataFrame(
        rows,
        "vehicle_id string, client_event_id string, derived_event_id string, client_us bigint, "
        "derived_us bigint, delta_seconds int, delta_meters double, score double",
    )
    assert pairs(greedy_match(df)) == want


def test_components_reach_over_days(spark):
    """A chain of pairs through midnights, and a pair that ends long after later ones began, are one component."""
    day = 86_400_000_000
    rows = [("v", f"c{k}", f"d{k}", k * day // 2, k * day // 2 + day // 2, 0, 0.0, 0.5) for k in range(6)]
    rows += [("v", f"c{k + 1}", f"d{k}", (k + 1) * day // 2, k * day // 2 + day // 2, 0, 0.0, 0.1 * (k % 3)) for k in range(5)]
    rows += [("v", "c0", "d9", 0, 9 * day, 0, 0.0, 0.3), ("v", "c8", "d9", 8 * day, 9 * day, 0, 0.0, 0.4), ("v", "c20", "d20", 20 * day, 20 * day, 0, 0.0, 0.9)]
    df = spark.createDataFrame(
        rows,
        "vehicle_id string, client_event_id string, derived_event_id string, client_us bigint, "
        "derived_us bigint, delta_seconds int, delta_meters double, score double",
    )
    taken, want = set(), set()
    for _, c, d, c_us, d_us, _, _, score in sorted(rows, key=lambda r: (r[7], r[3], r[1], r[4], r[2])):
        if c not in taken and d not in taken:
            taken |= {c, d}
            want.add((c, d))
    assert pairs(greedy_match(df.repartition(4))) == want


def test_contested_stops_lose_pairs(spark):
    c = stops(spark, "client", [(60 * k, 10 * k) for k in range(8)])
    d = stops(spark, "derived", [(60 * k + 20, 10 * k + 5) for k in range(8)])
    candidates = match_candidates(c, d)
    assert candidates.count() > greedy_match(candidates).count() == 8


def test_summary_and_agreement(spark):
    c, d = stops(spark, "client", [(0, 0), (600, 0)]), stops(spark, "derived", [(20, 10), (2400, 0)])
    matches, table = reconcile(c, d), all_stops(c, d)
    assert {r["id"] for r in unmatched(table, matches, "client").collect()} == {"c1"}
    assert {r["id"] for r in unmatched(table, matches, "derived").collect()} == {"d1"}
    low, high = F.timestamp_micros(F.lit(BASE_US - 1)), F.timestamp_micros(F.lit(BASE_US + 10**10))
    row = reconciliation_summary(table, matches, low, high).first().asDict()
    assert [row[k] for k in ("client_stops", "derived_stops", "matched", "client_only", "derived_only")] == [2, 2, 1, 1, 1]
    assert (row["mean_abs_delta_seconds"], row["mean_signed_delta_seconds"]) == (20, -20)
    per = agreement(table, matches.drop("vehicle_id")).first()
    assert (per["matched"], per["client_only"], per["mean_signed_delta_seconds"]) == (1, 1, -20)
    # Without a client stop in the window nothing counts as matched, and means are zero.
    late = reconciliation_summary(table, matches, F.timestamp_micros(F.lit(BASE_US + 10**7)), high).first()
    assert (late["matched"], late["derived_only"], late["mean_delta_meters"]) == (0, 2, 0.0)


def test_bias_and_scatter_are_told_apart(spark):
    def measured(offsets):
        c = stops(spark, "client", [(1000 * i + o, 0) for i, o in enumerate(offsets)])
        d = stops(spark, "derived", [(1000 * i, 0) for i in range(len(offsets))])
        return agreement(all_stops(c, d), reconcile(c, d)).first()

    late, scattered = measured([10, 10]), measured([10, -10])
    assert late["mean_abs_delta_seconds"] == scattered["mean_abs_delta_seconds"] == 10
    assert (late["mean_signed_delta_seconds"], scattered["mean_signed_delta_seconds"]) == (10, 0)
    assert LAT
