"""Cases at the edges: session time zones, known devices, window edges, malformed times, retried epochs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import at, make_positions, track
from test_sources import batch, reading, stamp, write_lines
from wayfold import schema
from wayfold.functions.validation import _text
from wayfold.operators.client import detect_client_stops, stops_from_emissions
from wayfold.operators.load import replace_derived, replace_matches
from wayfold.operators.ordered import WHOLE
from wayfold.operators.reads import active_days, first_n
from wayfold.plans.derivation import Derivation, _shaped, add_client_stops, read_stored, run_derivation, store_run
from wayfold.session import materialise
from wayfold.sources import batches as wire
from wayfold.sources import idindex, snapshots, tables
from wayfold.streaming import ingest

UTC = dt.timezone.utc


@pytest.fixture
def vancouver(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Vancouver")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_windows_of_stored_positions_follow_utc(spark, tmp_path, vancouver):
    early = dt.datetime(2026, 9, 2, 1, 0, tzinfo=UTC)
    rows = make_positions(spark, [("v", 0, 49.0, -123.0)]).withColumn("recorded_at", F.lit(early))
    path = f"{tmp_path}/positions"
    tables.append_positions(rows, path)
    day = dt.datetime(2026, 9, 2, tzinfo=UTC)
    zone = dt.timezone(dt.timedelta(hours=-7))
    for frm in (day, day.astimezone(zone), day.replace(tzinfo=None)):
        assert tables.read_positions(spark, path, frm, frm + dt.timedelta(days=1)).count() == 1
        assert tables.read_positions(spark, path, frm - dt.timedelta(days=1), frm).count() == 0


def test_active_days_follow_the_zone_asked_for(spark, vancouver):
    moment = dt.datetime(2026, 10, 18, 2, 0, tzinfo=UTC)
    rows = make_positions(spark, [("v", 0, 49.0, -123.0)]).withColumn("recorded_at", F.lit(moment))
    days = {zone: active_days(rows, zone).select(F.unix_seconds("day").alias("s")).first().s for zone in ("UTC", "America/Vancouver")}
    assert days == {
        "UTC": dt.datetime(2026, 10, 18, tzinfo=UTC).timestamp(),
        "America/Vancouver": dt.datetime(2026, 10, 17, tzinfo=UTC).timestamp(),
    }


def test_known_devices_keep_their_vehicle(spark, tmp_path):
    target = ingest.Target(str(tmp_path / "tables"))
    known = spark.createDataFrame([("uuid-1", "d", "d", at(0))], schema.VEHICLES)
    known.write.parquet(target.path("vehicles"))
    write_lines(tmp_path / "in", "a.json", [batch("d", [reading("r1")]), batch("e", [reading("r2")])])
    batches = wire.read_batches(spark, f"{tmp_path}/in")
    ingest.ingest_batch(target, batches, 0, F.lit(at(5)))
    stored = {r.reading_id: r.vehicle_id for r in tables.read_positions(spark, target.path("positions")).collect()}
    vehicles = {r.external_id: r.id for r in spark.read.parquet(target.path("vehicles")).collect()}
    assert stored == {"r1": "uuid-1", "r2": vehicles["e"]}


def test_a_retried_epoch_counts_the_same(spark, tmp_path):
    target = ingest.Target(str(tmp_path / "tables"))
    write_lines(tmp_path / "in", "a.json", [batch("d", [reading("r1"), reading("r2"), reading("r2")])])
    batches = wire.read_batches(spark, f"{tmp_path}/in")
    for _ in range(2):
        ingest.ingest_batch(target, batches, 0, F.lit(at(5)), "s")
        row = spark.read.parquet(target.path("audit")).first()
        assert (row.enqueued, row.inserted, row.duplicates, row.failures) == (3, 2, 1, 0)
        assert tables.read_positions(spark, target.path("positions")).count() == 2


@pytest.mark.parametrize("where", ["append_positions", "collapse_by_id", "load_audit"])
def test_a_load_cut_off_goes_on(spark, tmp_path, monkeypatch, where):
    """A failure before, after or between the writes: the retry adds what is missing and nothing twice."""
    target = ingest.Target(str(tmp_path / "tables"))
    write_lines(tmp_path / "in", "a.json", [batch("d", [reading("r1"), reading("r2")], [{"event_id": "e", "arrived_at": stamp(0), "lat": 1, "lon": 2}])])
    batches, real = wire.read_batches(spark, f"{tmp_path}/in"), getattr(ingest, where)

    def failing(*args):
        if where == "append_positions":
            real(args[0].limit(1), *args[1:])
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest, where, failing)
    with pytest.raises(RuntimeError):
        ingest.ingest_batch(target, batches, 3, F.lit(at(5)), "s")
    monkeypatch.setattr(ingest, where, real)
    # Meanwhile another stream brings one of the ids, which the first load may have stored or not.
    write_lines(tmp_path / "in2", "b.json", [batch("d", [reading("r2")])])
    ingest.ingest_batch(target, wire.read_batches(spark, f"{tmp_path}/in2"), 0, F.lit(at(5)), "t")
    ingest.ingest_batch(target, batches, 3, F.lit(at(5)), "s")
    assert sorted(r.reading_id for r in tables.read_positions(spark, target.path("positions")).collect()) == ["r1", "r2"]
    rows = {r.stream: tuple(r)[1:] for r in ingest.load_counters(spark, target).collect()}
    assert rows == {"s": (1, 2, 2, 0, 0, 1, 1), "t": (1, 1, 0, 1, 0, 0, 0)}
    assert ingest.read_client_stops(spark, target).count() == 1
    assert not (tmp_path / "tables" / "staged" / "load=s-3").exists()


def test_same_epoch_of_two_streams(spark, tmp_path):
    target = ingest.Target(str(tmp_path / "tables"))
    write_lines(tmp_path / "a", "a.json", [batch("d", [reading("z1"), reading("r1", lat=1.0)])])
    write_lines(tmp_path / "b", "b.json", [batch("d", [reading("a1"), reading("z1", 9), reading("m1", 100_000 * 86)])])
    for stream, folder in (("s", "a"), ("t", "b"), ("new", "b"), (None, "a"), (None, "a")):
        ingest.ingest_batch(target, wire.read_batches(spark, f"{tmp_path}/{folder}"), 0, F.lit(at(9_000_000)), stream)
    stored = tables.read_positions(spark, target.path("positions")).collect()
    assert sorted(r.reading_id for r in stored) == ["a1", "m1", "r1", "z1"]
    assert {r.reading_id: r.recorded_at for r in stored}["z1"] == at(0).replace(tzinfo=None)
    assert [r.seq for r in spark.read.parquet(target.path("audit")).orderBy("seq").collect()] == [0, 1, 2, 3, 4]
    seen = ingest.load_counters(spark, target).agg(F.sum("inserted"), F.sum("duplicates")).first()
    assert tuple(seen) == (4, 8)


def test_id_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idindex, "BUCKET_IDS", 50)
    index = idindex.IdIndex(spark, str(tmp_path / "index"))
    ids = lambda numbers: spark.createDataFrame([(f"id{k}",) for k in numbers], "x string")
    assert index.known(ids(range(3))).count() == 0
    for k in range(9):
        index.add(ids(range(100 * k, 100 * k + 130)), f"r{k}")
        index.add(ids(range(100 * k, 100 * k + 130)), f"r{k}")
    index.add(ids([]), "none")
    assert len(index.runs()) == 9 and {b for _, b, _ in index.runs()} == {4}
    asked = [*range(0, 2000, 7)]
    expected = sorted(f"id{k}" for k in asked if k < 930)
    assert sorted(r.id for r in index.known(ids(asked * 2)).collect()) == expected
    index.compact()
    assert [(b, n) for _, b, n in index.runs()] == [(32, 930)]
    assert sorted(r.id for r in index.known(ids(asked)).collect()) == expected
    # Of the many buckets only those of the ids that are there are read.
    read, real = [], index.stored
    index.stored = lambda parts: read.append(parts) or real(parts)
    plan = index.known(ids([5]))._jdf.queryExecution().executedPlan().toString()
    assert len(read[0]) <= 3 < 32
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("time", ["2026-09-01T09:00:00", "2026-09-01", "2026", "2026-13-01T00:00:00Z", "noon"])
def test_malformed_times_refuse_the_batch(spark, time):
    lines = [batch("good", [reading("r1")]), batch("bad", [reading("r2"), reading("r3", recorded_at=time)])]
    parsed = wire.parse_batches(spark.createDataFrame([(x,) for x in lines], "value string"))
    usable, refused = wire.judge_batches(parsed)
    assert [r.device_id for r in usable.collect()] == ["good"]
    assert [tuple(r) for r in refused.collect()] == [("bad", "malformed JSON")]


def test_ids_can_be_required_to_be_uuids(spark):
    good = "0191d1f5-7a2b-7cde-8f01-23456789abcd"
    lines = [batch("good", [reading(good)]), batch("bad", [reading("not-a-uuid")])]
    parsed = wire.parse_batches(spark.createDataFrame([(x,) for x in lines], "value string"), uuid_ids=True)
    assert [r.device_id for r in wire.judge_batches(parsed)[0].collect()] == ["good"]


def test_a_pair_across_the_window_edge_is_stored_once(spark):
    stops = spark.createDataFrame(
        [("c", "v", None, "client", at(-60), at(60), 0.0, 0.0, None), ("d", "v", None, "derived", at(10), at(70), 0.0, 0.0, None)], schema.STOP_EVENTS
    )
    pair = spark.createDataFrame([("c", "d", 70, 1.0, at(100))], schema.MATCHES)
    out = replace_matches(pair, stops, pair, at(0), at(3600)).collect()
    assert [(r.client_event_id, r.derived_event_id) for r in out] == [("c", "d")]


def test_numbers_in_reasons(spark):
    values = {1e9: "1e+09", 91.5: "91.5", -1234567.0: "-1.234567e+06", 100000.0: "100000", 0.0001: "0.0001", 0.00001: "1e-05", 0.0: "0", 1.5e300: "1.5e+300"}
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", _text("x").alias("t")).collect()
    assert {r.x: r.t for r in rows} == values


def test_first_n_with_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "4", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found = first_n(rows, ["k"], ["id"], 5, "id").collect()
            assert sorted((r.k, r.rn, r.id) for r in found) == sorted((k, n + 1, k + 3 * n) for k in range(3) for n in range(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stored_runs_replace_their_window(spark, tmp_path):
    day = 86_400
    samples = [(d * day + 30 * i, d * 5000 + (1200 if i > 3 else i * 300)) for d in range(3) for i in range(20)]
    p = track(spark, samples)
    client = stops_from_emissions(detect_client_stops(p, slicing=WHOLE)).withColumn("source", F.lit("client"))
    root, whole = f"{tmp_path}/t", (F.lit(at(-60)), F.lit(at(3 * day)), F.lit(at(4 * day)))
    add_client_stops(client, root)
    store_run(run_derivation(p, client, *whole), root, *whole)

    def stored(name):
        rows = read_stored(spark, root, name)
        return sorted(tuple(r) for r in rows.select(*[c for c in rows.columns if c.endswith("id") or c.endswith("ed_at") and c != "matched_at"]).collect())

    names = ("trips", "stop_events", "matches")
    first = {n: stored(n) for n in names}
    assert len(first["matches"]) == 3 and len(first["stop_events"]) == 6
    again = (*whole[:2], F.lit(at(5 * day)))
    store_run(run_derivation(p, client, *again), root, *again)
    assert {n: stored(n) for n in names} == first

    # One day anew: the same as replacing in snapshots, and the folders of other days keep their files.
    second = (F.lit(at(2 * day - 60)), F.lit(at(3 * day - 60)), F.lit(at(5 * day)))
    run = run_derivation(p, client, *second)
    whole_tables = [materialise(read_stored(spark, root, n)) for n in names[:2]]
    shaped = [_shaped(x, ddl).withColumn("source", F.lit("derived")) for x, ddl in ((run.trips, schema.TRIPS), (run.stops, schema.STOP_EVENTS))]
    expected = replace_derived(*whole_tables, *shaped, *second, vehicles=run.vehicles)
    before = snapshots.latest(spark, root)
    store_run(run, root, *second)
    for name, rows in zip(names, expected):
        assert len(stored(name)) == rows.count() and {r[0] for r in stored(name)} == {r.id for r in rows.collect()}
    after = snapshots.latest(spark, root)
    kept = [d for d, held in after.tables["stop_events"].items() if held == before.tables["stop_events"][d]]
    assert 0 < len(kept) < 3
    # A window reads the dates whose rows may touch it, the open stop's date among them, and no others.
    window = (F.lit(at(0)), F.lit(at(3600)))
    files = read_stored(spark, root, "stop_events", *window).inputFiles()
    assert files and all("date=2026-09-01" in f for f in files)

    # A day without any sample left loses its derived rows.
    gone = run_derivation(p.filter("false"), client, *second)
    store_run(Derivation(p.select("vehicle_id").distinct(), gone.trips, gone.stops, gone.client_stops, gone.matches), root, *second)
    assert len(stored("stop_events")) < len(first["stop_events"]) and len(stored("matches")) < 3
    snapshots.vacuum(spark, root, keep=1)
    assert len(stored("stop_events")) < len(first["stop_events"])


def test_a_run_that_fails_between_writes_changes_nothing(spark, tmp_path, monkeypatch):
    p = track(spark, [(30 * i, 0 if i > 5 else i * 300) for i in range(20)])
    client = stops_from_emissions(detect_client_stops(p, slicing=WHOLE))
    root, window = f"{tmp_path}/t", (F.lit(at(-60)), F.lit(at(3600)), F.lit(at(7200)))
    add_client_stops(client, root)
    run = run_derivation(p, client, *window)
    state = snapshots.latest(spark, root)
    monkeypatch.setattr(snapshots, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store_run(run, root, *window)
    assert snapshots.latest(spark, root) == state and read_stored(spark, root, "trips").count() == 0
    monkeypatch.undo()
    store_run(run, root, *window)
    assert read_stored(spark, root, "trips").count() == 1 and read_stored(spark, root, "matches").count() == 1
    # Who derived from an older state is told so.
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, state, {})


def test_compaction_keeps_every_row(spark, tmp_path):
    path = tmp_path / "positions"
    for k in range(6):
        rows = make_positions(spark, [("v", 86_400 * (k % 2) + k, 49.0, -123.0)]).withColumn("reading_id", F.lit(f"r{k}"))
        tables.append_positions(rows, str(path))
    before = sorted(map(tuple, tables.read_positions(spark, str(path)).collect()))
    folders = sorted(f for f in path.iterdir() if f.is_dir())
    tables.compact_positions(spark, str(path), at(0).date(), at(0).date())
    assert sorted(map(tuple, tables.read_positions(spark, str(path)).collect())) == before and len(before) == 6
    assert [len(list(f.glob("part-*"))) for f in folders] == [1, 3]
