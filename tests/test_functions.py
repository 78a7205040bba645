import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import at
from wayfold import schema
from wayfold.functions import geo, mapping, predicates, validation

# Reasons, labels, thresholds and edges in this file are what the results must be.
NAN = float("nan")
INF = float("inf")


def values(spark, column, rows, ddl="x double"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {ddl}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_great_circle(spark):
    pairs = [(0.0, 0.0, 1.0, 0.0), (49.0, 0.0, 49.01, 0.0), (60.0, 0.0, 60.0, 1.0), (5.0, 5.0, 5.0, 5.0)]
    got = values(spark, geo.haversine_m("a", "b", "c", "d"), pairs, "a double, b double, c double, d double")
    assert got == [pytest.approx(w, abs=t) for w, t in ((111_195, 100), (1111.95, 1), (55_597, 100), (0, 1e-9))]
    flat = values(spark, geo.equirect_m("a", "b", "c", "d"), pairs, "a double, b double, c double, d double")
    assert flat[2] == pytest.approx(111_320 * math.cos(math.radians(60)))


def test_zoom(spark):
    got = values(spark, geo.zoom_for_span("a", "b"), [(0.0, 0.0), (360.0, 1.0), (0.0, 1e-9), (0.1, 0.2)], "a double, b double")
    assert got == [16, 2, 18, 10]


def test_device_values(spark):
    assert values(spark, mapping.normalise_heading("x"), [None, -1.0, 360.0, 90.0]) == [None, None, 0.0, 90.0]
    motions = values(spark, mapping.motion_from("x"), [None, -1.0, 0.0, 0.49, 0.5, 2.49, 2.5])
    assert motions == ["unknown", "unknown", "still", "still", "walking", "walking", "driving"]
    levels = values(spark, mapping.battery_pct_from("x"), [None, -1.0, 0.0, 1.0000001, NAN, INF, 0.505])
    assert levels == [None, None, 0, 100, None, None, 51]


def test_tiers(spark):
    rows = [("still", 50, True), ("driving", 5, False), (None, 5, False), ("unknown", 5, False), ("still", 20, False), ("still", 19, False), ("still", None, False)]
    got = values(spark, mapping.sampling_tier("m", "b", "c"), rows, "m string, b int, c boolean")
    assert got == ["active", "active", "active", "active", "idle", "saver", "idle"]


def test_labels(spark):
    marks = [(0, None), (0, -5), (0, 29), (0, 30), (0, 59 * 60), (0, 3600), (0, 5400)]
    rows = [(at(a), None if b is None else at(b)) for a, b in marks]
    got = values(spark, mapping.dwell_label("a", "b"), rows, "a timestamp, b timestamp")
    assert got == ["still here", "unknown", "<1 min", "1 min", "59 min", "1h 0m", "1h 30m"]
    states = [(False, True, None), (True, False, at(0)), (True, True, None), (True, True, at(0))]
    state = mapping.tracking_state("r", "s", "t")
    got = values(spark, F.concat_ws("/", state, mapping.tracking_label(state)), states, "r boolean, s boolean, t timestamp")
    assert got == ["off/stopped", "blocked/location off", "awaiting-fix/no fix yet", "running/running"]
    sync = [(False, "both", 0, False), (True, "both", 0, True), (True, "local", 3, False), (True, "both", 3, False), (True, "server", 0, False)]
    got = values(spark, mapping.source_label("o", "s", "n", "f"), sync, "o boolean, s string, n bigint, f boolean")
    assert got == ["offline · local only", "no server · local only", "local only", "synced · 3 pending", "synced"]


GOOD = ("r", at(0), 49.0, -123.0, 1.0, 10.0, 5.0, 50, "still")
READINGS = [
    (dict(), None),
    (dict(reading_id=None), "reading_id is required"),
    (dict(reading_id=validation.NIL_ID), "reading_id is required"),
    (dict(recorded_at=None), "recorded_at is required"),
    (dict(recorded_at=at(86_400)), None),
    (dict(recorded_at=at(86_401)), "in the future"),
    (dict(recorded_at=at(-90 * 86_400)), None),
    (dict(lat=90.0), None),
    (dict(lat=90.1), "lat 90.1 out of range"),
    (dict(lat=-91.0), "lat -91 out of range [-90, 90]"),
    (dict(lon=181.0), "lon 181 out of range"),
    (dict(lat=INF), "out of range"),
    (dict(lat=NAN), "lat/lon must be finite numbers"),
    (dict(lon=NAN), "lat/lon must be finite numbers"),
    (dict(lat=NAN, lon=200.0), "lon 200 out of range"),
    (dict(speed_mps=0.0), None),
    (dict(speed_mps=-0.5), "speed_mps -0.5 must be a finite non-negative"),
    (dict(speed_mps=NAN), "speed_mps NaN must be"),
    (dict(heading_deg=360.0), None),
    (dict(heading_deg=360.5), "heading_deg 360.5 out of range"),
    (dict(accuracy_m=-1.0), "accuracy_m -1 must be"),
    (dict(battery_pct=101), "battery_pct 101 out of range"),
    (dict(battery_pct=-1), "battery_pct -1 out of range"),
    (dict(motion_state="flying"), 'motion_state "flying" is not recognised'),
    (dict(speed_mps=None, heading_deg=None, accuracy_m=None, battery_pct=None, motion_state=None), None),
]


def test_reading_rules(spark):
    names = [f.split(":")[0] for f in schema.READING[7:-1].split(",")]
    rows = [tuple((dict(zip(names, GOOD)) | change).values()) for change, _ in READINGS]
    ddl = schema.READING[7:-1].replace(":", " ")
    got = values(spark, validation.reading_reason(F.lit(at(0))), rows, ddl)
    for reason, (change, want) in zip(got, READINGS):
        assert (reason is None) if want is None else want in reason, (change, reason)


def test_stop_rules(spark):
    rows = [
        ("e", at(0), None, 49.0, -123.0),
        ("e", at(0), at(0), 49.0, -123.0),
        (None, at(0), None, 49.0, -123.0),
        ("e", None, None, 49.0, -123.0),
        ("e", at(90_000), None, 49.0, -123.0),
        ("e", at(0), at(-1), 49.0, -123.0),
        ("e", at(0), at(90_000), 49.0, -123.0),
        ("e", at(0), None, NAN, -123.0),
        ("e", at(0), None, 49.0, -181.0),
    ]
    got = values(spark, validation.stop_reason(F.lit(at(0))), rows, schema.STOP_REPORT[7:-1].replace(":", " "))
    want = [None, None, "event_id is", "arrived_at is required", "arrived_at is more", "departed_at is before", "departed_at is more", "lat NaN", "lon -181"]
    for reason, w in zip(got, want):
        assert (reason is None) if w is None else reason.startswith(w)


def test_windows():
    now = dt.datetime(2026, 9, 2, tzinfo=dt.timezone.utc)
    assert predicates.resolve_window(None, None, now) == (now - dt.timedelta(hours=24), now)
    start, _ = predicates.resolve_window("2026-09-01T00:00:00+02:00", None, now)
    assert start == dt.datetime(2026, 8, 31, 22, tzinfo=dt.timezone.utc)
    for frm, to in (("yesterday", None), ("2026-09-01", None), ("2026-09-03T00:00:00Z", None)):
        with pytest.raises(ValueError):
            predicates.resolve_window(frm, to, now)
    assert predicates.window_for(now, dt.timedelta(hours=6)) == (now - dt.timedelta(hours=6), now)
    assert predicates.day_window(now, now)[1] == now + dt.timedelta(seconds=1)
    with pytest.raises(ValueError):
        predicates.source_is("guess")
