"""Every operator as a query over the given tables, for the driver contract and the bench."""

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold import fixtures as fx
from wayfold import schema
from wayfold.config import DetectConfig, DrainConfig
from wayfold.functions import geo, mapping, predicates, validation
from wayfold.operators import client as client_ops
from wayfold.operators import (
    ledger,
    load,
    policy,
    quality,
    reads,
    reconcile,
    route,
    stops,
    trips,
)
from wayfold.operators.ordered import choose_slicing
from wayfold.plans.derivation import add_client_stops, read_stored, run_derivation, run_summary, store_run
from wayfold.plans.dirty import dirty_ranges, rederive
from wayfold.plans.route_view import route_view
from wayfold.session import ensure_checkpoint_dir, materialise
from wayfold.sources import batches as wire
from wayfold.sources import stoplog
from wayfold.streaming import ingest
from wayfold.streaming import stops as stream_stops

HOUR = 3_600_000_000
FROM, TO, NOW = fx.EPOCH_US + HOUR // 2, fx.EPOCH_US + HOUR * 3 // 2, fx.EPOCH_US + 3 * HOUR
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def us(column, name=None):
    return F.unix_micros(column).alias(name or f"{column.removesuffix('_at')}_us")


def metres(column, name=None):
    return F.round(column, 3).alias(name or column)


def big(column):
    return F.col(column).cast("bigint").alias(column)


def moment(value):
    return F.timestamp_micros(F.lit(value))


def n_of(column="reading_id"):
    """The number a derived id was made from."""
    return F.col(column).cast("bigint")


def detected(spark, d) -> tuple[DataFrame, DataFrame]:
    return trips.detect(fx.positions(spark, d), slicing=fx.slicing(spark, d))


def emissions(spark, d):
    return client_ops.detect_client_stops(fx.positions(spark, d), slicing=fx.slicing(spark, d))


def client_stops(spark, d):
    return client_ops.stops_from_emissions(emissions(spark, d))


def both(spark, d):
    """(client stops, derived stops), materialised, as most reconciliation queries read them twice."""
    derived = stops.detect_stops(fx.positions(spark, d), slicing=fx.slicing(spark, d))
    return materialise(client_stops(spark, d)), materialise(derived)


def vehicles(spark, d):
    """One vehicle per user; users divisible by 7 get a vehicle that never reported beside theirs."""
    users = fx.events(spark, d).select("user_id").distinct()
    silent = users.filter("user_id % 7 = 0").select(F.concat(F.lit("silent-"), "user_id").alias("id"))
    ids = users.select(F.col("user_id").cast("string").alias("id")).unionByName(silent)
    return ids.select(
        "id", F.concat(F.lit("dev-"), "id").alias("external_id"), F.col("id").alias("label"),
        moment(fx.EPOCH_US).alias("created_at"),
    )


# Derivation


@query
def trip_report(spark, d):
    """Trips and distance of every vehicle."""
    found, _ = detected(spark, d)
    return reads.trip_distance(found).select("vehicle_id", "trips", metres("distance_m"))


@query
def stop_detection(spark, d):
    found = stops.detect_stops(fx.positions(spark, d), slicing=fx.slicing(spark, d))
    return found.select("id", "vehicle_id", us("arrived_at"), us("departed_at"), "lat", "lon")


@query
def trip_detection(spark, d):
    found, _ = detected(spark, d)
    return found.select("id", "vehicle_id", us("started_at"), us("ended_at"), metres("distance_m"))


@query
def arriving_trip(spark, d):
    _, found = detected(spark, d)
    return found.select("vehicle_id", us("arrived_at"), "trip_id")


def cut(spark, d):
    """Positions, and a slicing under which the busiest vehicles are cut and the others stay whole."""
    p = fx.positions(spark, d)
    most = p.groupBy("vehicle_id").count().agg(F.max("count")).first()[0] or 0
    return p, choose_slicing(p, ["vehicle_id"], "recorded_at", max(1, most * 2 // 3))


@query
def cut_stop_detection(spark, d):
    p, sized = cut(spark, d)
    found = stops.detect_stops(p, slicing=sized)
    return found.select("id", "vehicle_id", us("arrived_at"), us("departed_at"), "lat", "lon")


@query
def cut_trip_detection(spark, d):
    p, sized = cut(spark, d)
    found, _ = trips.detect(p, slicing=sized)
    return found.select("id", "vehicle_id", us("started_at"), us("ended_at"), metres("distance_m"))


@query
def cut_parked_samples(spark, d):
    p, sized = cut(spark, d)
    marked = trips.mark_parked(p, materialise(stops.detect_stops(p, slicing=sized)), sized)
    return marked.select("vehicle_id", "reading_id", "parked")


@query
def cut_client_detection(spark, d):
    p, sized = cut(spark, d)
    found = client_ops.detect_client_stops(p, slicing=sized)
    return found.select("event_id", "vehicle_id", "kind", us("arrived_at"), us("departed_at"), "lat", "lon")


@query
def cut_sampling_backtest(spark, d):
    p, sized = cut(spark, d)
    found = policy.backtest_sampling(p, slicing=sized)
    return found.select("vehicle_id", us("changed_at"), "tier")


@query
def cut_route_thinning(spark, d):
    p, sized = cut(spark, d)
    return route.thin(p, slicing=sized).select("vehicle_id", "reading_id", us("recorded_at"))


@query
def parked_samples(spark, d):
    p, sized = fx.positions(spark, d), fx.slicing(spark, d)
    found = materialise(stops.detect_stops(p, slicing=sized))
    marked = trips.mark_parked(p, found, sized)
    return marked.select("vehicle_id", "reading_id", "parked")


@query
def sample_steps(spark, d):
    found = trips.with_steps(fx.positions(spark, d), fx.slicing(spark, d))
    return found.select(
        "vehicle_id",
        "reading_id",
        F.round(F.col("gap_seconds") * 1e6).cast("bigint").alias("gap_us"),
        metres("step_m"),
        metres("step_mps"),
    )


@query
def client_stop_detection(spark, d):
    found = emissions(spark, d)
    return found.select("event_id", "vehicle_id", "kind", us("arrived_at"), us("departed_at"), "lat", "lon")


@query
def client_stop_table(spark, d):
    return client_stops(spark, d).select("vehicle_id", us("arrived_at"), us("departed_at"), "lat", "lon")


@query
def emission_counts(spark, d):
    return client_ops.emission_counts(emissions(spark, d))


@query
def client_stop_stream(spark, d):
    """The streaming detector over the same fixes, arriving as deliveries in time order."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    p = materialise(fx.positions(spark, d))
    files = deliveries = 4
    moment_us = F.unix_micros("recorded_at")
    first, last = p.agg(F.min(moment_us), F.max(moment_us)).first()
    span = 0 if first is None else (last - first) // deliveries + 1
    for k in range(deliveries if span else 1):
        delivery = p.filter(moment_us.between(first + k * span, first + (k + 1) * span - 1)) if span else p
        delivery.repartition(files).write.mode("append").parquet(f"{root}/fixes")
    fixes = spark.readStream.schema(schema.POSITIONS).option("maxFilesPerTrigger", files).parquet(f"{root}/fixes")
    with stream_stops.rocksdb_state(spark):
        run = (
            stream_stops.detect_stops_stream(fixes)
            .writeStream.format("parquet")
            .option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    found = spark.read.parquet(f"{root}/out")
    return found.select("event_id", "vehicle_id", "kind", us("arrived_at"), us("departed_at"), "lat", "lon")


@query
def windowed_derivation(spark, d):
    p = fx.positions(spark, d)
    reported = materialise(client_stops(spark, d))
    run = run_derivation(p, reported, moment(FROM), moment(TO), moment(NOW), slicing=fx.slicing(spark, d))
    return run_summary(run).select(*[big(c) for c in (
        "vehicles", "trips", "derived_stops", "client_stops", "matched", "client_only", "derived_only",
    )])


@query
def late_rows(spark, d):
    """Trips after late rows, derived again only around these; the last 50 of every 500 rows of a vehicle come late."""
    p, sized = fx.positions(spark, d), fx.slicing(spark, d)
    late = F.unix_micros("received_at") - F.unix_micros("recorded_at") > HOUR
    last = F.when(late, F.lit(2)).otherwise(F.lit(1))
    p = materialise(p.withColumn("received_at", F.timestamp_micros(last * F.lit(HOUR))))
    before = [materialise(x) for x in trips.detect(p.filter(F.unix_micros("received_at") == HOUR), slicing=sized)]
    found, _ = rederive(p, *before, dirty_ranges(p, moment(2 * HOUR), slicing=sized), slicing=sized)
    return found.select("id", "vehicle_id", us("started_at"), us("ended_at"), metres("distance_m"))


@query
def stored_run(spark, d):
    """A run kept in tables, derived and kept a second time, and read back: (table, id, other), matches by both their stops."""
    root, window = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4()}", (moment(FROM), moment(TO), moment(NOW))
    p, reported = fx.positions(spark, d), materialise(client_stops(spark, d))
    add_client_stops(reported, root)
    run = run_derivation(p, reported, *window, slicing=fx.slicing(spark, d))
    for _ in range(2):
        store_run(run, root, *window)
    parts = {"trips": ("id", "vehicle_id"), "stop_events": ("id", "source"), "matches": ("client_event_id", "derived_event_id")}
    found = [
        read_stored(spark, root, name).select(F.lit(name).alias("kept_in"), F.col(a).alias("id"), F.col(b).alias("other"))
        for name, (a, b) in parts.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


# Reconciliation


@query
def match_candidates(spark, d):
    c, s = both(spark, d)
    pairs = reconcile.match_candidates(c, s)
    return pairs.select(
        "vehicle_id", "client_us", "derived_us", big("delta_seconds"), metres("delta_meters"),
        F.round("score", 6).alias("score"),
    )


@query
def stop_matches(spark, d):
    c, s = both(spark, d)
    found = reconcile.reconcile(c, s)
    return found.select(
        "vehicle_id", "client_event_id", "derived_event_id", big("delta_seconds"), metres("delta_meters")
    )


@query
def contested_matches(spark, d):
    """Tolerances so wide that most stops could be matched with several others: only some of the pairs are taken."""
    c, s = both(spark, d)
    found = reconcile.reconcile(c, s, DetectConfig(match_max_seconds=1800.0, match_max_m=5000.0))
    return found.select("vehicle_id", "client_event_id", "derived_event_id", big("delta_seconds"), metres("delta_meters"))


@query
def matches_in_window(spark, d):
    c, s = both(spark, d)
    found = reconcile.matched_in_window(reconcile.reconcile(c, s), c, moment(FROM), moment(TO))
    return found.select("client_event_id", "derived_event_id", big("delta_seconds"))


@query
def unmatched_stops(spark, d):
    c, s = both(spark, d)
    found, table = reconcile.reconcile(c, s), reconcile.all_stops(c, s)
    sides = [reconcile.unmatched(table, found, side) for side in ("client", "derived")]
    return sides[0].unionByName(sides[1]).select("source", "vehicle_id", us("arrived_at"))


@query
def reconciliation_summary(spark, d):
    c, s = both(spark, d)
    found = reconcile.reconciliation_summary(
        reconcile.all_stops(c, s), reconcile.reconcile(c, s), moment(FROM), moment(TO)
    )
    return found.select(*[
        metres(c) if c.startswith("mean") else big(c) for c in found.columns
    ])


@query
def vehicle_agreement(spark, d):
    c, s = both(spark, d)
    found = reconcile.agreement(reconcile.all_stops(c, s), reconcile.reconcile(c, s))
    return found.select("vehicle_id", *[
        metres(c) if c.startswith("mean") else big(c) for c in found.columns[1:]
    ])


@query
def both_sources(spark, d):
    c, s = both(spark, d)
    return reconcile.all_stops(c, s).groupBy("vehicle_id", "source").agg(
        F.count(F.lit(1)).alias("stops"), F.count_if(F.col("departed_at").isNull()).alias("open_stops")
    )


# Reads


@query
def window_resolution(spark, d):
    """What a read finds for bounds given as texts, one of them with another offset, or left out."""
    p, now, parts = fx.positions(spark, d), dt.datetime.fromtimestamp(NOW / 1e6, dt.timezone.utc), None
    asked = {"both": ("2024-01-01T00:30:00Z", "2024-01-01T02:30:00+01:00"), "from": ("2024-01-01T01:00:00Z", None), "none": (None, None)}
    for name, (frm, to) in asked.items():
        low, high = predicates.resolve_window(frm, to, now)
        found = p.filter(predicates.in_window("recorded_at", low, high)).agg(F.count(F.lit(1)).alias("positions"), F.countDistinct("vehicle_id").alias("vehicles"))
        found = found.select(F.lit(name).alias("asked"), "positions", "vehicles")
        parts = found if parts is None else parts.unionByName(found)
    return parts


@query
def derivation_scan(spark, d):
    found = reads.samples(fx.positions(spark, d), moment(FROM), moment(TO))
    return found.select("vehicle_id", us("recorded_at"), "lat", "lon", F.round(F.col("speed_mps").cast("double"), 3).alias("speed_mps"))


@query
def active_vehicles(spark, d):
    return reads.active_vehicles(fx.positions(spark, d), moment(FROM), moment(TO))


@query
def position_pages(spark, d):
    found = reads.positions_page(fx.positions(spark, d), moment(FROM), moment(TO), 20)
    return found.select("vehicle_id", big("seq"), "reading_id", us("recorded_at"), "truncated")


@query
def local_history(spark, d):
    found = reads.local_since(fx.positions(spark, d), moment(FROM), 25)
    return found.select("vehicle_id", big("seq"), "reading_id", us("recorded_at"))


@query
def vehicle_trips(spark, d):
    found, _ = detected(spark, d)
    listed = reads.list_trips(found, moment(FROM), moment(TO), moment(NOW))
    return listed.select("vehicle_id", us("started_at"), us("ended_at"), metres("distance_m"))


@query
def vehicle_stops(spark, d):
    c, s = both(spark, d)
    listed = reads.list_stops(reconcile.all_stops(c, s), moment(FROM), moment(TO), moment(NOW), "derived")
    return listed.select("vehicle_id", us("arrived_at"), us("departed_at"), "source")


@query
def vehicle_list(spark, d):
    found = reads.list_vehicles(vehicles(spark, d), fx.positions(spark, d))
    return found.select("id", "external_id", us("last_reported_at"))


@query
def last_reports(spark, d):
    return reads.last_reports(fx.positions(spark, d)).select("vehicle_id", us("last_reported_at"))


@query
def most_recent_vehicle(spark, d):
    found = reads.most_recent_vehicle(vehicles(spark, d), fx.positions(spark, d))
    return found.select("id", us("last_reported_at"))


@query
def latest_positions(spark, d):
    found = reads.latest_position(fx.positions(spark, d))
    return found.select("vehicle_id", "reading_id", us("recorded_at"), "lat", "lon", "motion_state")


@query
def last_fixes(spark, d):
    found = reads.last_fix(fx.positions(spark, d))
    return found.select("vehicle_id", "fixes", "lat", "lon", big("accuracy_m"), us("recorded_at"))


@query
def position_count(spark, d):
    return reads.count_positions(fx.positions(spark, d))


def day_positions(spark, d):
    """Positions on the uncompressed clock, so that they span a month."""
    raw = fx.events(spark, d)
    return raw.select(
        F.col("user_id").cast("string").alias("vehicle_id"), F.expr("cast(ts as timestamp)").alias("recorded_at")
    )


@query
def active_days(spark, d):
    found = reads.active_days(day_positions(spark, d), "America/Vancouver", 10)
    return found.select(
        "vehicle_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "fixes", us("first"), us("last")
    )


@query
def trip_distance_per_day(spark, d):
    found, _ = detected(spark, d)
    daily = reads.trip_distance(found.withColumn("day", F.date_format("started_at", "yyyy-MM-dd")), ("vehicle_id", "day"))
    return daily.select("vehicle_id", "day", "trips", metres("distance_m"))


# Routes


@query
def route_bounds(spark, d):
    found = route.bounds(fx.positions(spark, d))
    return found.select("vehicle_id", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query
def route_camera(spark, d):
    found = route.camera(fx.positions(spark, d))
    return found.select(
        "vehicle_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), big("zoom")
    )


@query
def route_thinning(spark, d):
    found = route.thin(fx.positions(spark, d), slicing=fx.slicing(spark, d))
    return found.select("vehicle_id", "reading_id", us("recorded_at"))


def route_sides(spark, d):
    """The device keeps two rows of three; the server has four of five, marked by a moved latitude."""
    p = fx.positions(spark, d)
    local = p.filter(n_of() % 3 != 0)
    server = p.filter(n_of() % 5 != 0).withColumn("lat", F.col("lat") + 1)
    return local, server


@query
def route_merge(spark, d):
    rows, _ = route.merge_positions(*route_sides(spark, d))
    return rows.select("vehicle_id", "reading_id", us("recorded_at"), F.round("lat", 6).alias("lat"))


@query
def route_merge_stats(spark, d):
    _, stats = route.merge_positions(*route_sides(spark, d))
    label = mapping.source_label(F.lit(True), "source", "local_only", F.lit(False))
    return stats.select("vehicle_id", big("local_rows"), big("server_rows"), big("local_only"), "source", label.alias("status"))


@query
def route_screen(spark, d):
    points, frames, _ = route_view(*route_sides(spark, d), moment(FROM), moment(TO), slicing=fx.slicing(spark, d))
    shown = points.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("points"))
    return shown.join(frames, "vehicle_id").select("vehicle_id", "points", F.round("latitude", 6).alias("latitude"), big("zoom"))


# Column functions


@query
def distances(spark, d):
    """Distance of every fix from its vehicle's home corner, both ways of measuring."""
    p = fx.positions(spark, d)
    return p.select(
        "reading_id",
        metres(geo.haversine_m(F.lit(49.0), F.lit(-123.0), "lat", "lon"), "great_circle_m"),
        metres(geo.equirect_m(F.lit(49.0), F.lit(-123.0), "lat", "lon"), "flat_m"),
    )


@query
def reading_mapping(spark, d):
    """Raw device values to stored ones."""
    e = F.col("event_id")
    raw = fx.events(spark, d).select(
        "event_id",
        F.when(e % 17 != 0, (e % 400 - 10).cast("double")).alias("heading"),
        F.when(e % 11 != 0, ((e % 50 - 5) / 10).cast("double")).alias("speed"),
        F.when(e % 13 != 0, ((e % 120 - 5) / 100).cast("double")).alias("level"),
        (e % 7 == 0).alias("charging"),
    )
    return (
        raw.withColumn("motion", mapping.motion_from("speed"))
        .withColumn("battery_pct", mapping.battery_pct_from("level"))
        .withColumn("tier", mapping.sampling_tier("motion", "battery_pct", "charging"))
        .withColumn("profile", mapping.tier_profile("tier"))
        .select(
            "event_id",
            mapping.normalise_heading("heading").alias("heading"),
            "motion",
            big("battery_pct"),
            "tier",
            F.col("profile.time_interval_ms").cast("bigint").alias("interval_ms"),
            F.col("profile.distance_interval_m").cast("bigint").alias("interval_m"),
        )
    )


@query
def zoom_levels(spark, d):
    e = F.col("event_id")
    spans = fx.events(spark, d).select(
        "event_id", ((e % 1000) * F.lit(0.001)).alias("a"), ((e % 37) * F.lit(0.02)).alias("b")
    )
    return spans.select("event_id", geo.zoom_for_span("a", "b").cast("bigint").alias("zoom"))


@query
def dwell_labels(spark, d):
    found = stops.detect_stops(fx.positions(spark, d), slicing=fx.slicing(spark, d))
    return found.select(
        "vehicle_id", us("arrived_at"), mapping.dwell_label("arrived_at", "departed_at").alias("dwell")
    )


@query
def tracking_health(spark, d):
    status = reads.list_vehicles(vehicles(spark, d), fx.positions(spark, d)).select(
        "id",
        (F.length("id") % 5 != 0).alias("registered"),
        (~F.col("id").endswith("3")).alias("enabled"),
        "last_reported_at",
    )
    state = mapping.tracking_state("registered", "enabled", "last_reported_at")
    return status.select("id", state.alias("state")).select(
        "id",
        "state",
        mapping.tracking_label("state").alias("label"),
        mapping.is_healthy("state").alias("healthy"),
        mapping.needs_user_action("state").alias("needs_action"),
    )


@query
def fix_quality(spark, d):
    usable = fx.positions(spark, d).filter(predicates.usable_fix(50.0))
    still = usable.select("vehicle_id", predicates.is_stationary(1.0).alias("still"))
    return still.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("usable"), F.count_if("still").alias("stationary")
    )


# Validation and sources


def flawed_readings(spark, d):
    """Readings with one kind of fault per modulus."""
    n = F.col("n")
    p = fx.positions(spark, d).withColumn("n", n_of())
    return p.withColumns(
        {
            "reading_id": F.when(n % 101 == 0, F.lit(None)).otherwise(F.col("reading_id")),
            "recorded_at": F.when(n % 103 == 0, F.col("recorded_at") + F.expr("INTERVAL 49 HOURS")).otherwise(
                F.col("recorded_at")
            ),
            "lat": F.when(n % 107 == 0, F.lit(91.5)).when(n % 109 == 0, F.lit(float("nan"))).otherwise(F.col("lat")),
            "lon": F.when(n % 113 == 0, F.lit(-181.0)).otherwise(F.col("lon")),
            "speed_mps": F.when(n % 127 == 0, F.lit(-1.0)).otherwise(F.col("speed_mps")).cast("float"),
            "heading_deg": F.when(n % 131 == 0, F.lit(361.0)).otherwise(F.col("heading_deg")).cast("float"),
            "accuracy_m": F.when(n % 137 == 0, F.lit(-5.0)).otherwise(F.col("accuracy_m")).cast("float"),
            "battery_pct": F.when(n % 139 == 0, F.lit(101)).otherwise(F.col("battery_pct")).cast("smallint"),
            "motion_state": F.when(n % 149 == 0, F.lit("flying")).otherwise(F.col("motion_state")),
        }
    )


@query
def reading_validation(spark, d):
    _, rejected = validation.split_valid(
        flawed_readings(spark, d), validation.reading_reason, moment(fx.EPOCH_US + 24 * HOUR), "reading_id"
    )
    return rejected


@query
def readings_accepted(spark, d):
    accepted, _ = validation.split_valid(
        flawed_readings(spark, d), validation.reading_reason, moment(fx.EPOCH_US + 24 * HOUR), "reading_id"
    )
    return accepted.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("accepted"))


@query
def stop_validation(spark, d):
    n = n_of("event_id")
    arrived = F.col("recorded_at")
    reports = fx.positions(spark, d).select(
        F.col("reading_id").alias("event_id"), "recorded_at", "lat", "lon"
    )
    flawed = reports.select(
        F.when(n % 101 != 0, F.col("event_id")).alias("event_id"),
        F.when(n % 103 == 0, F.lit(None)).otherwise(arrived).alias("arrived_at"),
        F.when(n % 107 == 0, arrived - F.expr("INTERVAL 1 SECOND"))
        .when(n % 109 == 0, arrived + F.expr("INTERVAL 60 HOURS"))
        .when(n % 2 == 0, arrived + F.expr("INTERVAL 5 MINUTES"))
        .alias("departed_at"),
        F.when(n % 113 == 0, F.lit(float("nan"))).otherwise(F.col("lat")).alias("lat"),
        F.when(n % 127 == 0, F.lit(200.0)).otherwise(F.col("lon")).alias("lon"),
    )
    _, rejected = validation.split_valid(
        flawed, validation.stop_reason, moment(fx.EPOCH_US + 24 * HOUR), "event_id"
    )
    return rejected


@query
def batch_validation(spark, d):
    e = F.col("event_id")
    reading = F.lit(None).cast(schema.READING)
    report = F.lit(None).cast(schema.STOP_REPORT)
    made = fx.events(spark, d).select(
        "event_id",
        F.when(e % 19 != 0, F.concat(F.lit("dev-"), "user_id")).otherwise("").alias("device_id"),
        F.array_repeat(reading, F.when(e % 10 == 0, e % 1300).otherwise(e % 3).cast("int")).alias("readings"),
        F.array_repeat(report, F.when(e % 9 == 0, e % 260).otherwise(e % 2).cast("int")).alias("stop_events"),
    )
    judged = made.select("event_id", validation.batch_reason().alias("reason"))
    return judged.filter("reason is not null")


def device_queue(spark, d):
    """Positions and stop reports as a device would queue them."""
    p = fx.positions(spark, d).withColumn("device_id", F.concat(F.lit("dev-"), "vehicle_id"))
    reports = emissions(spark, d).withColumn("device_id", F.concat(F.lit("dev-"), "vehicle_id"))
    return p, reports


def sent_batches(spark, d):
    p, reports = device_queue(spark, d)
    made = wire.to_batches(p, reports, moment(NOW), 50, fx.slicing(spark, d))
    return made.select("batch_no", "value")


@query
def batch_building(spark, d):
    parsed = wire.parse_batches(sent_batches(spark, d))
    return parsed.select(
        "device_id",
        big("batch_no"),
        F.size("readings").cast("bigint").alias("n_readings"),
        F.size("stop_events").cast("bigint").alias("n_stops"),
        F.size(F.filter("readings", lambda r: r["speed_mps"].isNull())).cast("bigint").alias("n_no_speed"),
    )


@query
def telemetry_batches(spark, d):
    """Readings that went through JSON and back."""
    sent = wire.parse_batches(sent_batches(spark, d))
    usable, _ = wire.judge_batches(sent.withColumn("received_at", moment(NOW)))
    found = wire.batch_readings(usable)
    return found.select(
        "device_id", "reading_id", us("recorded_at"), "lat", "lon",
        F.round(F.col("speed_mps").cast("double"), 3).alias("speed_mps"), big("battery_pct"), "motion_state",
    )


@query
def telemetry_stops(spark, d):
    """Stop reports that went through JSON and back."""
    sent = wire.parse_batches(sent_batches(spark, d))
    usable, _ = wire.judge_batches(sent.withColumn("received_at", moment(NOW)))
    found = wire.batch_stops(usable)
    return found.select("device_id", us("arrived_at"), us("departed_at"), "lat", "lon")


@query
def ingest_response(spark, d):
    """Accepted readings and stops per device, faulty readings aside."""
    moved = F.concat(F.lit("dev-"), "vehicle_id")
    readings = flawed_readings(spark, d).withColumn("device_id", moved)
    good, _ = validation.split_valid(
        readings, validation.reading_reason, moment(fx.EPOCH_US + 24 * HOUR), "reading_id"
    )
    found = wire.ingest_response(good, emissions(spark, d).withColumn("device_id", moved))
    return found.select("device_id", big("accepted"), big("accepted_stops"))


@query
def batch_answers(spark, d):
    """What batches with faulty readings are answered: up to 1000 readings of a vehicle in each, and the faulty ones named."""
    fields = [f.split(":")[0] for f in schema.READING[7:-1].split(",")]
    sent = flawed_readings(spark, d).groupBy("vehicle_id", F.expr("n div 1000").alias("batch_no"))
    items = F.array_sort(F.collect_list(F.struct("n", F.struct(*fields).alias("r"))))
    batches = sent.agg(F.transform(items, lambda x: x["r"].cast(schema.READING)).alias("readings")).withColumns({
        "device_id": F.when(F.col("batch_no") % 7 != 3, F.concat(F.lit("dev-"), "vehicle_id")).otherwise(""),
        "stop_events": F.lit(None).cast(f"array<{schema.STOP_REPORT}>"),
        "received_at": moment(fx.EPOCH_US + 24 * HOUR),
        wire.CORRUPT: F.lit(None).cast("string"),
    })
    found = wire.answer_batches(batches, ["vehicle_id", "batch_no"])
    named = F.transform("rejected", lambda r: F.concat_ws(": ", r["id"], r["reason"]))
    return found.select("vehicle_id", big("batch_no"), "reason", "accepted", "accepted_stops", F.array_join(named, "; ").alias("rejected"))


@query
def clock_offsets(spark, d):
    n = n_of()
    sent = fx.positions(spark, d).select(
        F.concat(F.lit("dev-"), "vehicle_id").alias("device_id"),
        "received_at",
        F.when(n % 5 != 0, F.col("recorded_at") + F.expr("INTERVAL 250 MILLISECONDS")).alias("sent_at"),
    )
    found = wire.clock_offsets(sent)
    return found.select("device_id", "batches", metres("mean_offset_ms"))


@query
def ingest_stream(spark, d):
    """JSON batches written to a folder, loaded by the micro-batch stream, and read back."""
    root = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4()}"
    sent = materialise(sent_batches(spark, d))
    wire.write_batches(sent, f"{root}/in")
    wire.write_batches(sent.filter("batch_no % 2 = 0"), f"{root}/in")
    target = ingest.Target(root)
    source = wire.read_batches(spark, f"{root}/in", streaming=True)
    ingest.start_ingest(source, target, f"{root}/checkpoint", {"availableNow": True}, moment(NOW)).awaitTermination()
    stored = spark.read.parquet(target.path("positions"))
    return stored.select("reading_id", us("recorded_at"), "lat", big("battery_pct"))


@query
def ingest_streams(spark, d):
    """Two streams and, later, a new checkpoint whose epochs count from 0 again, all loading one target: every id once."""
    root = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4()}"
    sent = materialise(sent_batches(spark, d))
    wire.write_batches(sent.filter("batch_no % 3 <> 1"), f"{root}/one")
    wire.write_batches(sent.filter("batch_no % 3 <> 0"), f"{root}/two")
    target = ingest.Target(f"{root}/tables")
    for folder, checkpoint in (("one", "a"), ("two", "b"), ("two", "c")):
        source = wire.read_batches(spark, f"{root}/{folder}", streaming=True)
        ingest.start_ingest(source, target, f"{root}/{checkpoint}", {"availableNow": True}, moment(NOW)).awaitTermination()
    stored = spark.read.parquet(target.path("positions"))
    return stored.groupBy("reading_id").agg(F.count(F.lit(1)).alias("times"), F.min(F.unix_micros("recorded_at")).alias("recorded_us"))


# Loads


def replayed(spark, d):
    """A batch holding every reading, and the even ones a second time with another latitude."""
    p = fx.positions(spark, d)
    again = p.filter(n_of() % 2 == 0).withColumn("lat", F.lit(0.0))
    return p.withColumn("batch_seq", F.lit(0)).unionByName(again.withColumn("batch_seq", F.lit(1)))


@query
def idempotent_load(spark, d):
    existing = fx.positions(spark, d).filter(n_of() % 3 == 0)
    new_rows, _ = load.load_positions(existing, replayed(spark, d), ("batch_seq",))
    return new_rows.select("reading_id", "vehicle_id", F.round("lat", 6).alias("lat"))


@query
def load_audit(spark, d):
    existing = fx.positions(spark, d).filter(n_of() % 3 == 0)
    _, audit = load.load_positions(existing, replayed(spark, d), ("batch_seq",))
    return audit.select(big("enqueued"), big("inserted"), big("duplicates"))


def stop_reports(spark, d):
    """Each client stop reported open and, once left, closed, in either order, and open once more.
    The closed report carries another latitude."""
    c = materialise(client_stops(spark, d))
    odd = F.unix_micros("arrived_at") % 2
    opened = c.withColumn("departed_at", F.lit(None).cast("timestamp")).withColumn("batch_seq", odd)
    closed = c.filter("departed_at is not null").withColumn("lat", F.col("lat") + 1)
    closed = closed.withColumn("batch_seq", 1 - odd)
    return opened.unionByName(closed).unionByName(opened.withColumn("batch_seq", F.lit(2).cast("bigint")))


@query
def stop_report_collapse(spark, d):
    found = load.collapse_by_id(stop_reports(spark, d))
    return found.select("vehicle_id", us("arrived_at"), us("departed_at"), F.round("lat", 6).alias("lat"))


def stop_snapshot(reports):
    """Stored stops: a third of them, still open."""
    c = reports.filter("batch_seq = 2").filter(F.unix_micros("arrived_at") % 3 == 0).drop("batch_seq")
    return c.withColumn("departed_at", F.lit(None).cast("timestamp"))


@query
def client_stop_merge(spark, d):
    reports = stop_reports(spark, d)
    snapshot, _ = load.merge_client_stops(stop_snapshot(reports), reports)
    return snapshot.select("vehicle_id", us("arrived_at"), us("departed_at"), F.round("lat", 6).alias("lat"))


@query
def client_stop_merge_effects(spark, d):
    reports = stop_reports(spark, d)
    _, affected = load.merge_client_stops(stop_snapshot(reports), reports)
    return affected.groupBy("change").agg(F.count(F.lit(1)).alias("stops"))


@query
def client_stop_log(spark, d):
    """The stop table resolved from an append-only log of the same reports, one batch each."""
    found = load.resolve_stop_log(stop_reports(spark, d))
    return found.select("vehicle_id", us("arrived_at"), us("departed_at"), F.round("lat", 6).alias("lat"))


@query
def client_stop_state(spark, d):
    """The same from stored loads that arrive out of order: two of three are compacted one after the other, the third is laid over."""
    root = f"{ensure_checkpoint_dir(spark)}/stops-{uuid.uuid4()}"
    log, state = f"{root}/log", f"{root}/state"
    reports = materialise(stop_reports(spark, d).withColumn("received_at", moment(NOW)))
    for third in (1, 2, 0):
        part = reports.filter(F.col("batch_seq") % 3 == third)
        part.select(*[c.split(" ")[0] for c in stoplog.STOP_LOG.split(", ")]).write.parquet(f"{log}/load={third}")
        if third:
            stoplog.compact(spark, log, state)
    found = stoplog.read_stops(spark, log, state)
    return found.select("vehicle_id", us("arrived_at"), us("departed_at"), F.round("lat", 6).alias("lat"))


@query
def derived_window_replace(spark, d):
    """Recompute the window with a wider minimum dwell and lay it over the stored derivation."""
    t, s = detected(spark, d)
    p = fx.positions(spark, d)
    table = reconcile.all_stops(client_stops(spark, d), s)
    inside = p.filter(predicates.in_window("recorded_at", moment(FROM), moment(TO)))
    new_t, new_s = trips.detect(inside, DetectConfig(stop_min_seconds=240), fx.slicing(spark, d))
    t2, s2 = load.replace_derived(
        t, table, new_t, new_s, moment(FROM), moment(TO), moment(NOW), reads.active_vehicles(p, moment(FROM), moment(TO))
    )
    spans = t2.select(F.lit("trip").alias("what"), "vehicle_id", "source", us("started_at", "from_us"), us("ended_at", "to_us"))
    return spans.unionByName(
        s2.select(F.lit("stop").alias("what"), "vehicle_id", "source", us("arrived_at", "from_us"), us("departed_at", "to_us"))
    )


@query
def match_window_replace(spark, d):
    """Replace the matches of a window by those found under half the distance tolerance."""
    c, s = both(spark, d)
    old = reconcile.reconcile(c, s)
    inside = c.filter(predicates.in_window("arrived_at", moment(FROM), moment(TO)))
    new = reconcile.reconcile(inside, s, DetectConfig(match_max_m=1.0))
    found = load.replace_matches(old, c, new, moment(FROM), moment(TO))
    return found.select("client_event_id", "derived_event_id", big("delta_seconds"))


@query
def orphan_matches(spark, d):
    """Matches left after a third of the derived stops is deleted."""
    c, s = both(spark, d)
    left = reconcile.all_stops(c, s.filter(F.unix_micros("arrived_at") % 3 != 0))
    found = load.drop_orphan_matches(reconcile.reconcile(c, s), left)
    return found.select("client_event_id", "derived_event_id")


@query
def vehicle_registration(spark, d):
    known = vehicles(spark, d).filter(~F.col("id").endswith("1"))
    seen = fx.events(spark, d).select(F.concat(F.lit("dev-"), "user_id").alias("device_id"))
    found = load.register_vehicles(known, seen, moment(NOW))
    return found.select("id", "external_id", "label", us("created_at"))


@query
def local_retention(spark, d):
    kept, dropped = load.retain_since(fx.positions(spark, d), moment(FROM))
    return reads.count_positions(kept).withColumn("what", F.lit("kept")).unionByName(
        dropped.select(F.col("dropped").alias("positions"), F.lit("dropped").alias("what"))
    )


@query
def broken_references(spark, d):
    """The rules that constraint_report's rows keep: references to rows that are not there, and a stop's place and source."""
    t, s = (materialise(found) for found in detected(spark, d))
    t = t.withColumn("vehicle_id", F.when(F.unix_micros("started_at") % 5 == 0, "ghost").otherwise(F.col("vehicle_id")))
    case = F.unix_micros("arrived_at") % 10
    broken = {
        "vehicle_id": F.when(case == 0, "ghost").otherwise(F.col("vehicle_id")),
        "trip_id": F.when(case == 1, "none").otherwise(F.col("trip_id")),
        "lat": F.when(case == 2, 91.0).otherwise(F.col("lat")),
        "lon": F.when(case == 3, -200.0).otherwise(F.col("lon")),
        "source": F.when(case == 4, "guess").otherwise(F.col("source")),
    }
    lost = F.concat(F.lit("none-"), "id")
    matches = s.filter(case.isin(5, 6)).select(
        F.when(case == 5, lost).otherwise(F.col("id")).alias("client_event_id"), F.when(case == 6, lost).otherwise(F.col("id")).alias("derived_event_id")
    )
    found = quality.constraint_violations(fx.positions(spark, d), t, s.withColumns(broken), matches, vehicles(spark, d))
    return found.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("rows"))


@query
def constraint_report(spark, d):
    t, s = (materialise(found) for found in detected(spark, d))
    c = materialise(client_stops(spark, d))
    n = n_of()
    p = flawed_readings(spark, d).withColumn(
        "vehicle_id", F.when(n % 151 == 0, "ghost").otherwise(F.col("vehicle_id"))
    )
    odd = F.unix_micros("started_at") % 10
    t = t.withColumns(
        {
            "source": F.when(odd == 1, "guess").otherwise(F.col("source")),
            "ended_at": F.when(odd == 2, F.col("started_at") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("ended_at")),
            "distance_m": F.when(odd == 3, F.lit(-1.0)).otherwise(F.col("distance_m")),
        }
    )
    table = reconcile.all_stops(c, s)
    late = F.unix_micros("arrived_at") % 10
    table = table.withColumn(
        "departed_at",
        F.when(late == 1, F.col("arrived_at") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("departed_at")),
    )
    matches = c.select(F.col("id").alias("client_event_id"), F.col("id").alias("derived_event_id"))
    found = quality.constraint_violations(p, t, table, matches, vehicles(spark, d))
    return found.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("rows"))


@query
def open_trip_check(spark, d):
    t, _ = detected(spark, d)
    opened = t.withColumn("ended_at", F.when(F.unix_micros("started_at") % 4 != 0, F.col("ended_at")))
    return quality.multiple_open_trips(opened)


# Policy

BANDS = DrainConfig(band_starts=(20, 25, 30))


@query
def sampling_backtest(spark, d):
    found = policy.backtest_sampling(fx.positions(spark, d), slicing=fx.slicing(spark, d))
    return found.select("vehicle_id", us("changed_at"), "tier")


@query
def battery_drain(spark, d):
    found = policy.battery_drain(fx.positions(spark, d), BANDS, slicing=fx.slicing(spark, d))
    return found.select("band", "vehicle_hours", metres("hours"), big("spent_pct"), metres("drain_pct_per_hour"))


@query
def battery_drain_stationary(spark, d):
    p = fx.positions(spark, d).withColumn(
        "motion_state", F.when(F.col("vehicle_id").cast("bigint") % 2 == 0, "still").otherwise(F.col("motion_state"))
    )
    found = policy.battery_drain(p, BANDS, stationary_only=True, slicing=fx.slicing(spark, d))
    return found.select("band", "vehicle_hours", metres("hours"), big("spent_pct"), metres("drain_pct_per_hour"))


# Delivery ledger


def queue(spark, d):
    """Queued items: one per reading, two of five of them stop reports sharing an event id in pairs."""
    n = n_of()
    payload = F.when(
        n % 5 < 2, F.to_json(F.struct(F.concat(F.lit("e"), F.expr("cast(reading_id as bigint) div 5")).alias("event_id")))
    ).otherwise(F.to_json(F.struct("reading_id")))
    return fx.positions(spark, d).select(
        F.concat(F.lit("q"), "reading_id").alias("id"),
        F.concat(F.lit("dev-"), "vehicle_id").alias("device_id"),
        F.when(n % 5 < 2, "stop_event").otherwise("position").alias("kind"),
        "recorded_at",
        payload.alias("payload"),
        (n % 6).cast("int").alias("attempts"),
        F.lit(None).cast("string").alias("last_error"),
        F.col("recorded_at").alias("created_at"),
    )


def number_in_queue():
    return F.substring("id", 2, 20).cast("bigint")


def sent_queue(spark, d):
    """The queue with the batch each item was sent in."""
    n = number_in_queue()
    return queue(spark, d).withColumn("batch_id", F.concat_ws("-", "device_id", n % 7))


def answers(spark, d):
    sent = sent_queue(spark, d)
    part = F.split("batch_id", "-")
    n = ((part[1].cast("bigint") + part[2].cast("bigint")) % 4).cast("int")
    kinds = F.array(*[F.lit(kind) for kind in ("accepted", "shed", "rejected", "unavailable")])
    batches = sent.select("batch_id").distinct().withColumn("n", n)
    outcomes = batches.select(
        "batch_id", F.get(kinds, F.col("n")).alias("outcome"), F.concat(F.lit("reason "), "n").alias("reason")
    )
    refused = ledger.with_wire_id(sent.filter(number_in_queue() % 25 < 5)).select("batch_id", F.col("wire_id").alias("id"))
    return sent, outcomes, refused


def planned(spark, d):
    sent, outcomes, refused = answers(spark, d)
    verdicts = ledger.resolve_acks(sent, refused).filter(number_in_queue() % 11 != 0)
    return sent, ledger.plan_outcomes(sent, outcomes, verdicts)


@query
def ack_translation(spark, d):
    sent, _, refused = answers(spark, d)
    return ledger.resolve_acks(sent, refused)


@query
def delivery_plan(spark, d):
    _, actions = planned(spark, d)
    return actions.select("id", "outcome", "verdict", "action", "error")


@query
def ledger_update(spark, d):
    sent, actions = planned(spark, d)
    live, _ = ledger.apply_actions(sent, actions, moment(NOW))
    return live.select("id", big("attempts"), "last_error")


@query
def quarantine_split(spark, d):
    sent, actions = planned(spark, d)
    _, dead = ledger.apply_actions(sent, actions, moment(NOW))
    return dead.select("id", big("attempts"), "reason", us("quarantined_at"))


@query
def drain_counts(spark, d):
    sent, actions = planned(spark, d)
    return ledger.drain_counts(sent, actions)


@query
def queue_insert(spark, d):
    items = queue(spark, d)
    stored = items.filter(number_in_queue() % 2 == 0)
    fresh = items.withColumn("attempts", F.lit(0))
    return ledger.enqueue(stored, fresh).select("id", big("attempts"))


@query
def queue_peek(spark, d):
    return ledger.oldest_n(queue(spark, d), 10).select("device_id", big("position"), "id")


@query
def queue_trim(spark, d):
    kept, _ = ledger.trim_to_cap(queue(spark, d), 40)
    return kept.select("device_id", "id")


@query
def queue_dropped(spark, d):
    _, dropped = ledger.trim_to_cap(queue(spark, d), 40)
    return dropped


@query
def dead_items(spark, d):
    n = number_in_queue()
    dead = queue(spark, d).withColumn("quarantined_at", F.timestamp_micros(F.lit(NOW) + n % 1000))
    return ledger.dead_items(dead, 5).select("device_id", big("position"), "id")
