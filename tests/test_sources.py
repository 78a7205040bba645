import datetime as dt
import json
import os

from pyspark.sql import functions as F

from conftest import LON, at, make_positions, place, track
from wayfold import schema
from wayfold.functions import validation
from wayfold.operators import ledger
from wayfold.operators.client import detect_client_stops, emission_counts, stops_from_emissions
from wayfold.operators.ordered import WHOLE, Slicing
from wayfold.operators.route import bounds, camera, merge_positions
from wayfold.plans.derivation import run_derivation, run_summary
from wayfold.plans.route_view import route_view
from wayfold.sources import batches as wire
from wayfold.sources import tables
from wayfold.streaming import ingest, stops as stream_stops


def stamp(seconds):
    return at(seconds).isoformat().replace("+00:00", "Z")


def batch(device, readings=(), reports=(), **extra):
    return json.dumps({"device_id": device, "sent_at": stamp(0), "readings": list(readings), "stop_events": list(reports), **extra})


def reading(i, seconds=0, **changes):
    return {"reading_id": i, "recorded_at": stamp(seconds), "lat": 49.0, "lon": -123.0, **changes}


def write_lines(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_reading_json_batches(spark, tmp_path):
    lines = [
        batch("d1", [reading("r1", speed_mps=0, future_field={"a": 1}), reading("r2")], shiny=True),
        '{"device_id": "d2", "readings": [',
        batch("", [reading("r3")]),
        batch("d4"),
        batch("d5", [{"reading_id": "r5", "recorded_at": stamp(1)}], [{"event_id": "e1", "arrived_at": stamp(0), "lat": 1, "lon": 2}]),
    ]
    write_lines(tmp_path, "a.json", lines)
    read = wire.read_batches(spark, str(tmp_path))
    usable, refused = wire.judge_batches(read.withColumn("received_at", F.lit(at(5))))
    assert {r["device_id"] for r in usable.collect()} == {"d1", "d5"}
    reasons = sorted(r["reason"] for r in refused.collect())
    assert reasons == ["batch must contain readings or stop_events", "device_id is required", "malformed JSON"]
    rows = {r["reading_id"]: r for r in wire.batch_readings(usable).collect()}
    assert rows["r1"]["speed_mps"] == 0.0 and rows["r2"]["speed_mps"] is None
    assert (rows["r5"]["lat"], rows["r5"]["lon"]) == (0.0, 0.0)
    assert wire.batch_stops(usable).first()["departed_at"] is None
    offsets = wire.clock_offset(usable).select("offset_ms").distinct().collect()
    assert [r[0] for r in offsets] == [5000]


def test_batches_leave_absent_values_out(spark):
    p = make_positions(spark, [("v", i, 49.0, LON, 1.0 if i == 0 else None) for i in range(5)])
    p = p.withColumn("device_id", F.col("vehicle_id"))
    s = detect_client_stops(p, slicing=WHOLE).withColumn("device_id", F.col("vehicle_id"))
    rows = wire.to_batches(p, s, F.lit(at(9)), 3, WHOLE).orderBy("batch_no").collect()
    bodies = [json.loads(r["value"]) for r in rows]
    assert [len(b["readings"]) for b in bodies] == [3, 2]
    assert "speed_mps" in bodies[0]["readings"][0] and "speed_mps" not in bodies[0]["readings"][1]
    sliced = wire.to_batches(p, s, F.lit(at(9)), 3, Slicing(2_000_000)).orderBy("batch_no").collect()
    assert sliced == rows


def test_one_bad_row_does_not_cost_the_others(spark):
    rows = make_positions(spark, [("v", 0, 49.0, LON), ("v", 0, 95.0, LON)])
    good, bad = validation.split_valid(rows, validation.reading_reason, F.lit(at(0)), "reading_id")
    assert [r["reading_id"] for r in good.collect()] == ["00000000"]
    assert [(r["id"], r["reason"]) for r in bad.collect()] == [("00000001", "lat 95 out of range [-90, 90]")]


def test_position_files_prune_by_date(spark, tmp_path):
    path = str(tmp_path / "positions")
    p = track(spark, [(0, 0), (86_400, 1), (2 * 86_400, 2)])
    tables.append_positions(p, path, files=2)
    day = dt.timedelta(days=1)
    found = tables.read_positions(spark, path, at(0) + day, at(0) + day + dt.timedelta(hours=1))
    assert [r["reading_id"] for r in found.collect()] == ["00000001"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(recorded_date" in plan and "PushedFilters: [IsNotNull(recorded_at)" in plan


def run_stream(spark, fixes, root, deliveries):
    """Deliver DataFrames one micro-batch each and return the emissions."""
    os.makedirs(f"{root}/in")
    source = spark.readStream.schema(schema.POSITIONS).parquet(f"{root}/in")
    with stream_stops.rocksdb_state(spark):
        for delivery in deliveries:
            delivery.coalesce(1).write.mode("append").parquet(f"{root}/in")
            (
                stream_stops.detect_stops_stream(source)
                .writeStream.format("parquet")
                .option("path", f"{root}/out")
                .option("checkpointLocation", f"{root}/check")
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
    return spark.read.parquet(f"{root}/out")


def test_stream_equals_batch(spark, tmp_path):
    samples = [(30 * i, 0) for i in range(8)] + [(240 + 30 * i, 400 * i) for i in range(1, 4)]
    samples += [(400 + 30 * i, 1200) for i in range(10)]
    p = track(spark, samples)
    cuts = [0, 100, 130, 300, 500, 10_000]
    deliveries = [
        p.filter((F.col("recorded_at") >= at(a)) & (F.col("recorded_at") < at(b))).orderBy(F.desc("recorded_at"))
        for a, b in zip(cuts, cuts[1:])
    ]
    # A late fix far away, delivered after newer ones, must not end the stop it predates.
    late = make_positions(spark, [("v", 40, place(9000), LON)])
    deliveries.insert(2, late)
    got = run_stream(spark, p, str(tmp_path), deliveries)
    want = detect_client_stops(p, slicing=WHOLE)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    counts = emission_counts(got).first()
    assert (counts["arrived"], counts["departed"], counts["open"]) == (2, 1, True)
    stops = stops_from_emissions(got).orderBy("arrived_at").collect()
    assert [s["departed_at"] is None for s in stops] == [False, True]


def test_client_detector_rules(spark):
    def kinds(rows):
        found = detect_client_stops(make_positions(spark, rows), slicing=WHOLE).collect()
        return sorted((r["kind"], (r["arrived_at"] - at(0).replace(tzinfo=None)).seconds) for r in found)

    near = [("v", s, place(s / 30), LON, 0.0) for s in range(0, 120, 15)]
    assert kinds(near) == [("arrived", 0)]
    assert kinds(near[:3]) == []
    bad = [(*r, 80.0) for r in near]
    assert kinds(bad) == []
    moving_inside = [(v, s, a, o, 9.0 if s else 0.0) for v, s, a, o, _ in near]
    assert kinds(moving_inside) == [("arrived", 0)]
    assert kinds([(v, s, a, o, 9.0) for v, s, a, o, _ in near]) == []
    unknown = [(v, s, a, o, None) for v, s, a, o, _ in near]
    assert kinds(unknown) == [("arrived", 0)]


def test_answers_name_what_is_refused_and_resolve_the_devices_queue(spark):
    stop = {"event_id": "e1", "arrived_at": stamp(50), "departed_at": stamp(0), "lat": 49.0, "lon": -123.0}
    lines = [
        ("b1", batch("d1", [reading("r1"), reading("r2", lat=95), reading(""), reading("r3", 5)], [stop, {**stop, "event_id": "e2", "departed_at": None}])),
        ("b2", batch("d1", [reading("r4")], **{"stop_events": None})),
        ("b3", batch("", [reading("r5", lat=95)], [])),
        ("b4", "not json"),
    ]
    parsed = wire.parse_batches(spark.createDataFrame(lines, "batch_id string, value string")).withColumn("received_at", F.lit(at(60)))
    answers = wire.answer_batches(parsed, ["batch_id"])
    found = {r["batch_id"]: (r["reason"], r["accepted"], r["accepted_stops"], [x["id"] for x in r["rejected"]], [tuple(x) for x in r["rejected_stops"]]) for r in answers.collect()}
    assert found == {
        "b1": (None, 2, 1, ["r2", ""], [("e1", "departed_at is before arrived_at")]),
        "b2": (None, 1, 0, [], []),
        "b3": ("device_id is required", 0, 0, [], []),
        "b4": ("malformed JSON", 0, 0, [], []),
    }
    named = wire.rejections(answers, ["batch_id"])
    assert {(r["batch_id"], r["kind"], r["id"]) for r in named.collect()} == {("b1", "reading", "r2"), ("b1", "reading", ""), ("b1", "stop", "e1")}
    queue = [("b1", "q1", json.dumps({"reading_id": "r1"})), ("b1", "q2", json.dumps({"reading_id": "r2"})), ("b1", "q3", json.dumps({"event_id": "e1"})),
             ("b2", "q4", json.dumps({"reading_id": "r2"}))]
    verdicts = ledger.resolve_acks(spark.createDataFrame(queue, "batch_id string, id string, payload string"), named).collect()
    assert {r["id"]: r["verdict"] for r in verdicts} == {"q1": "accepted", "q2": "rejected", "q3": "rejected", "q4": "accepted"}


def test_ingest_replay_changes_nothing(spark, tmp_path):
    target = ingest.Target(str(tmp_path / "tables"))
    (tmp_path / "in").mkdir()
    source = wire.read_batches(spark, str(tmp_path / "in"), streaming=True)

    def load():
        ingest.start_ingest(source, target, str(tmp_path / "check"), {"availableNow": True}, F.lit(at(60))).awaitTermination()

    opened = {"event_id": "e1", "arrived_at": stamp(0), "lat": 49.0, "lon": -123.0}
    closed = {**opened, "departed_at": stamp(50), "lat": 50.0}
    write_lines(tmp_path / "in", "1.json", [batch("d1", [reading("r1"), reading("r2", 5, lat=99)], [opened])])
    load()
    write_lines(tmp_path / "in", "2.json", [batch("d1", [reading("r1", lat=12.0), reading("r3", 7)], [closed]), batch("d2", [reading("r4")])])
    load()
    write_lines(tmp_path / "in", "3.json", [batch("d1", [reading("r1"), reading("r3", 7)], [opened]), "not json"])
    load()
    positions = {r["reading_id"]: r["lat"] for r in tables.read_positions(spark, target.path("positions")).collect()}
    assert positions == {"r1": 49.0, "r3": 49.0, "r4": 49.0}
    stop = ingest.read_client_stops(spark, target).collect()
    assert len(stop) == 1 and stop[0]["lat"] == 49.0
    assert stop[0]["departed_at"] == at(50).replace(tzinfo=None)
    devices = spark.read.parquet(target.path("vehicles")).collect()
    assert sorted(r["external_id"] for r in devices) == ["d1", "d2"]
    audit = [tuple(r)[:3] for r in spark.read.parquet(target.path("audit")).orderBy("epoch").collect()]
    assert audit == [(1, 1, 0), (3, 2, 1), (2, 0, 2)]
    refused = {(r["kind"], r["reason"]) for r in spark.read.parquet(target.path("rejected")).collect()}
    assert refused == {("reading", "lat 99 out of range [-90, 90]"), ("batch", "malformed JSON")}
    answers = sorted((r["reason"] or "", r["accepted"], r["accepted_stops"], len(r["rejected"])) for r in ingest.read_answers(spark, target).collect())
    assert answers == [("", 1, 0, 0), ("", 1, 1, 1), ("", 2, 1, 0), ("", 2, 1, 0), ("malformed JSON", 0, 0, 0)]
    assert ingest.compact_client_stops(spark, target) == 3
    assert ingest.read_client_stops(spark, target).collect() == stop


def test_routes(spark):
    local = track(spark, [(0, 0), (10, 100), (20, 200)])
    server = local.filter("reading_id <> '00000002'").withColumn("lat", F.col("lat") + 1)
    rows, stats = merge_positions(local, server)
    assert rows.count() == 3 and rows.filter("lat > 50").count() == 2
    s = stats.first()
    assert (s["local_rows"], s["server_rows"], s["local_only"], s["source"]) == (3, 2, 1, "both")
    holes = local.withColumn("lat", F.when(F.col("reading_id") == "00000001", float("nan")).otherwise(F.col("lat")))
    assert bounds(holes).first()["max_lat"] == place(200)
    assert bounds(local.withColumn("lat", F.lit(float("nan")))).first()["max_lat"] is None
    lost = camera(local.withColumn("lat", F.lit(float("nan")))).first()
    assert tuple(lost)[1:] == (49.2827, -123.1207, 11)
    points, frame, _ = route_view(local, server, at(0), at(60))
    assert points.count() == 3 and frame.count() == 1


def test_derivation_run(spark):
    samples = [(s, s * 10) for s in range(0, 120, 30)] + [(120 + 30 * i, 1200) for i in range(10)]
    p = track(spark, samples).unionByName(track(spark, [(99_999, 0)], "late").withColumn("reading_id", F.lit("x")))
    client = stops_from_emissions(detect_client_stops(p, slicing=WHOLE))
    run = run_derivation(p, client, F.lit(at(0)), F.lit(at(3600)), F.lit(at(7200)))
    row = run_summary(run).first().asDict()
    assert row == {"vehicles": 1, "trips": 1, "derived_stops": 1, "client_stops": 1, "matched": 1, "client_only": 0, "derived_only": 0}
    nothing = run_derivation(p, client, F.lit(at(0)), F.lit(at(3600)), F.lit(at(7200)), changed_since=F.lit(at(5000)))
    assert run_summary(nothing).first()["vehicles"] == 0
