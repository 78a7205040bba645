import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import LON, at, make_positions, place, track
from wayfold.operators import ledger, load, quality, reads
from wayfold.operators.reconcile import all_stops

REPORT = "id string, vehicle_id string, arrived_at timestamp, departed_at timestamp, lat double, lon double, received_at timestamp, batch_seq bigint"
STOP = "id string, vehicle_id string, trip_id string, source string, arrived_at timestamp, departed_at timestamp, lat double, lon double, received_at timestamp"
TRIP = "id string, vehicle_id string, source string, started_at timestamp, ended_at timestamp, distance_m double"


def reports(spark, rows):
    """rows: (id, departed seconds or None, metres north) in batch order."""
    return spark.createDataFrame(
        [
            (i, "v", at(0), None if left is None else at(left), place(m), LON, at(0), n)
            for n, (i, left, m) in enumerate(rows)
        ],
        REPORT,
    )


def test_first_write_wins_and_replay_adds_nothing(spark):
    batch = track(spark, [(0, 0), (10, 5), (20, 9)])
    empty = batch.filter("false")
    new, audit = load.load_positions(empty, batch)
    assert (new.count(), tuple(audit.first())) == (3, (3, 3, 0))
    again, audit = load.load_positions(new, batch.withColumn("lat", F.lit(0.0)))
    assert (again.count(), tuple(audit.first())) == (0, (3, 0, 3))
    both = track(spark, [(0, 0), (10, 5), (20, 9), (30, 1), (40, 2)])
    more, audit = load.load_positions(new, both)
    assert {r["reading_id"] for r in more.collect()} == {"00000003", "00000004"}
    assert tuple(audit.first()) == (5, 2, 3)


def test_null_stays_apart_from_zero(spark):
    rows = make_positions(spark, [("v", 0, 49.0, LON, 0.0), ("v", 1, 49.0, LON, None)])
    new, _ = load.load_positions(rows.filter("false"), rows)
    assert {r["speed_mps"] for r in new.collect()} == {0.0, None}


MERGES = {
    "open then closed": ([("a", None, 0)], [("a", 60, 0)], 60, 0),
    "closed then late open": ([("a", 60, 0)], [("a", None, 0)], 60, 0),
    "altered completion": ([("a", None, 0)], [("a", 60, 500)], 60, 0),
    "closed twice": ([("a", 60, 0)], [("a", 90, 0)], 60, 0),
    "open replay": ([("a", None, 0)], [("a", None, 7)], None, 0),
    "both at once": ([], [("a", None, 0), ("a", 60, 0)], 60, 0),
    "both at once, closed first": ([], [("a", 60, 0), ("a", None, 0)], 60, 0),
}


@pytest.mark.parametrize("name", MERGES)
def test_guarded_merge(spark, name):
    stored, batch, left, metres = MERGES[name]
    table = spark.createDataFrame([], STOP)
    if stored:
        table, _ = load.merge_client_stops(table, reports(spark, stored))
    merged, affected = load.merge_client_stops(table, reports(spark, batch))
    row = merged.collect()
    assert len(row) == 1
    assert row[0]["departed_at"] == (None if left is None else at(left).replace(tzinfo=None))
    assert row[0]["lat"] == pytest.approx(place(metres)) and row[0]["source"] == "client"
    changes = {r["change"] for r in affected.collect()}
    assert changes == ({"inserted"} if not stored else {"closed"} if stored[0][1] is None and left else set())
    again, affected = load.merge_client_stops(merged, reports(spark, batch))
    assert again.exceptAll(merged).count() == 0 and affected.count() == 0
    log = load.collapse_by_id(reports(spark, stored)).withColumn("batch_seq", F.lit(0)) if stored else None
    new = load.collapse_by_id(reports(spark, batch)).withColumn("batch_seq", F.lit(1))
    log = new if log is None else log.unionByName(new)
    resolved = load.resolve_stop_log(log.unionByName(new)).first()
    assert (resolved["departed_at"], resolved["lat"]) == (row[0]["departed_at"], row[0]["lat"])


def test_replacing_a_window_keeps_client_rows_and_other_vehicles(spark):
    def stop(i, source, arrived, departed, vehicle="v"):
        return (i, vehicle, None, source, at(arrived), None if departed is None else at(departed), 49.0, LON, at(0))

    stops = spark.createDataFrame(
        [
            stop("before", "derived", 0, 99),
            stop("edge", "derived", 0, 100),
            stop("inside", "derived", 150, 160),
            stop("open", "derived", 10, None),
            stop("client", "client", 150, 160),
            stop("after", "derived", 200, 210),
            stop("other", "derived", 150, 160, "w"),
        ],
        STOP,
    )
    trips = spark.createDataFrame([("t", "v", "derived", at(120), at(130), 5.0)], TRIP)
    new_stops = stops.filter("id = 'inside'").withColumn("id", F.lit("new"))
    mine = spark.createDataFrame([("v",)], "vehicle_id string")
    args = (trips, stops, trips.filter("false"), new_stops, F.lit(at(100)), F.lit(at(200)), F.lit(at(500)))
    t, s = load.replace_derived(*args, vehicles=mine)
    assert t.count() == 0
    assert {r["id"] for r in s.collect()} == {"before", "client", "after", "other", "new"}
    _, s = load.replace_derived(*args)
    assert "other" not in {r["id"] for r in s.collect()}


def test_vehicles_register_once(spark):
    none = spark.createDataFrame([], "id string, external_id string, label string, created_at timestamp")
    devices = spark.createDataFrame([("a",), ("b",), ("a",), ("",)], "device_id string")
    first = load.register_vehicles(none, devices, F.lit(at(0)))
    again = load.register_vehicles(first, devices, F.lit(at(9)))
    assert sorted(r["external_id"] for r in again.collect()) == ["a", "b"]
    assert again.exceptAll(first).count() == 0


def test_pages(spark):
    p = track(spark, [(i, i) for i in range(10)])
    low, high = F.lit(at(0)), F.lit(at(9))
    for limit, n, truncated in ((4, 4, True), (9, 9, False), (0, 9, False)):
        rows = reads.positions_page(p, low, high, limit).orderBy("seq").collect()
        assert [r["reading_id"] for r in rows] == [f"{i:08d}" for i in range(n)]
        assert {r["truncated"] for r in rows} == {truncated}


def test_trip_overlap(spark):
    spans = {"before": (-9, -5), "overlap": (-5, -3), "inside": (-2, -1), "open": (-8, None), "after": (1, 2)}
    hour = dt.timedelta(hours=1)
    trips = spark.createDataFrame(
        [(k, "v", "derived", at(0) + a * hour, None if b is None else at(0) + b * hour, 0.0) for k, (a, b) in spans.items()],
        TRIP,
    )
    rows = reads.list_trips(trips, F.lit(at(0) - 4 * hour), F.lit(at(0)), F.lit(at(0))).collect()
    assert [r["id"] for r in rows] == ["inside", "overlap", "open"]
    assert quality.multiple_open_trips(trips.unionByName(trips)).first()["open_trips"] == 2


def test_active_days_follow_the_zone(spark):
    p = spark.createDataFrame(
        [("v", dt.datetime(2026, 10, 18, h, 30, tzinfo=dt.timezone.utc)) for h in (6, 8)],
        "vehicle_id string, recorded_at timestamp",
    )
    def days(tz):
        return sorted(r["day"].day for r in reads.active_days(p, tz).collect())
    assert days("UTC") == [18]
    assert days("America/Vancouver") == [17, 18]
    assert [r["day"].day for r in reads.active_days(p, "America/Vancouver", 1).collect()] == [18]
    with pytest.raises(Exception, match="(?i)zone"):
        days("Mars/Olympus")


def test_vehicle_order(spark):
    v = spark.createDataFrame(
        [("1", "b", "b", at(0)), ("2", "a", "a", at(0)), ("v", "c", "c", at(0))],
        "id string, external_id string, label string, created_at timestamp",
    )
    p = track(spark, [(0, 0), (10, 0)])
    assert [r["id"] for r in reads.list_vehicles(v, p).collect()] == ["v", "2", "1"]
    assert reads.most_recent_vehicle(v, p).first()["id"] == "v"
    assert reads.latest_position(p).first()["reading_id"] == "00000001"


def test_sources_share_a_table(spark):
    c = reports(spark, [("a", None, 0)]).withColumn("source", F.lit("client"))
    assert all_stops(c, c.withColumn("source", F.lit("derived"))).count() == 2


def queued(spark, rows):
    """rows: (id, payload, attempts, batch)."""
    return spark.createDataFrame(
        [(i, "d", "position", at(n), p, a, None, at(n), b) for n, (i, p, a, b) in enumerate(rows)],
        "id string, device_id string, kind string, recorded_at timestamp, payload string, attempts int, "
        "last_error string, created_at timestamp, batch_id string",
    )


def test_delivery_outcomes(spark):
    q = queued(
        spark,
        [
            ("1", '{"reading_id":"r1"}', 0, "ok"),
            ("2", '{"event_id":"e"}', 0, "ok"),
            ("3", '{"event_id":"e"}', 0, "ok"),
            ("4", '{"reading_id":"r4"}', 2, "ok"),
            ("5", "{}", 0, "busy"),
            ("6", "{}", 3, "bad"),
            ("7", "{}", 4, "bad"),
            ("8", "{}", 9, "down"),
        ],
    )
    outcomes = spark.createDataFrame(
        [("ok", "accepted", None), ("busy", "shed", None), ("bad", "rejected", "HTTP 400"), ("down", "unavailable", "no route")],
        "batch_id string, outcome string, reason string",
    )
    refused = spark.createDataFrame([("ok", "e")], "batch_id string, id string")
    verdicts = ledger.resolve_acks(q, refused).filter("id <> '4'")
    actions = ledger.plan_outcomes(q, outcomes, verdicts)
    got = {r["id"]: (r["action"], r["verdict"]) for r in actions.collect()}
    assert got == {
        "1": ("remove", "accepted"), "2": ("remove", "rejected"), "3": ("remove", "rejected"), "4": ("fail", None),
        "5": ("keep", None), "6": ("fail", None), "7": ("quarantine", None), "8": ("fail", None),
    }
    live, dead = ledger.apply_actions(q, actions, F.lit(at(99)))
    attempts = {r["id"]: (r["attempts"], r["last_error"]) for r in live.collect()}
    assert attempts["4"] == (3, "1 item(s) missing from the server response")
    assert attempts["5"] == (0, None) and attempts["8"] == (10, "no route")
    assert [(r["id"], r["reason"]) for r in dead.collect()] == [("7", "HTTP 400")]
    counts = ledger.drain_counts(q, actions).first().asDict()
    assert counts == {"device_id": "d", "sent": 8, "accepted": 1, "rejected": 2, "quarantined": 1, "dropped": 0, "remaining": 4}


def test_queue_order_and_cap(spark):
    q = queued(spark, [(str(i), "{}", 0, "b") for i in range(6)])
    assert [r["id"] for r in ledger.oldest_n(q, 2).orderBy("position").collect()] == ["0", "1"]
    kept, dropped = ledger.trim_to_cap(q, 4)
    assert sorted(r["id"] for r in kept.collect()) == ["2", "3", "4", "5"] and dropped.first()["dropped"] == 2
    more = ledger.enqueue(q.withColumn("attempts", F.lit(3)), queued(spark, [("5", "{}", 0, "b"), ("9", "{}", 0, "b")]))
    assert {r["id"]: r["attempts"] for r in more.collect()} | {"5": 3, "9": 0} == {r["id"]: r["attempts"] for r in more.collect()}
