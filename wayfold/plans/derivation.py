"""Recompute a window: trips, stops and matches of every vehicle that reported in it."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold import schema
from wayfold.config import DetectConfig
from wayfold.functions.predicates import at, in_window, overlaps
from wayfold.operators.ordered import Slicing
from wayfold.operators.reads import active_vehicles, samples
from wayfold.operators.reconcile import reconcile
from wayfold.operators.trips import detect
from wayfold.session import materialise
from wayfold.sources.snapshots import Change, commit, latest
from wayfold.sources.tables import utc_date


@dataclass(frozen=True)
class Derivation:
    vehicles: DataFrame
    trips: DataFrame
    stops: DataFrame
    client_stops: DataFrame
    matches: DataFrame


def run_derivation(
    positions: DataFrame,
    client_stops: DataFrame,
    frm,
    to,
    now,
    cfg: DetectConfig = DetectConfig(),
    slicing: Slicing | None = None,
    changed_since=None,
) -> Derivation:
    """Derive [frm, to) and match it with the client stops overlapping the window.

    The window is recomputed whole, so the result does not depend on what ran before. With
    changed_since, only vehicles with a position received from then on are recomputed.
    """
    vehicles = active_vehicles(positions, frm, to)
    if changed_since is not None:
        fresh = positions.filter(F.col("received_at") >= changed_since).select("vehicle_id").distinct()
        vehicles = vehicles.join(fresh, "vehicle_id", "left_semi")
        positions = positions.join(fresh, "vehicle_id", "left_semi")
    trips, stops = detect(samples(positions, frm, to), cfg, slicing)
    stops = materialise(stops)
    reported = client_stops.filter(
        (F.col("source") == "client") & overlaps("arrived_at", "departed_at", frm, to, now)
    ).join(vehicles, "vehicle_id", "left_semi")
    return Derivation(vehicles, trips, stops, reported, reconcile(reported, stops, cfg))


#: How the stored tables date their rows.
SPANS = {
    "trips": (schema.TRIPS, "started_at", "ended_at"),
    "stop_events": (schema.STOP_EVENTS, "arrived_at", "departed_at"),
    # A match is kept on the day its client stop arrived.
    "matches": (f"{schema.MATCHES}, client_arrived_at timestamp", "client_arrived_at", "client_arrived_at"),
}
DAY_US = 86_400_000_000


def read_stored(spark, root: str, name: str, frm=None, to=None) -> DataFrame:
    """Rows of a stored table in the state of the last commit; with [frm, to), of the dates that may touch it."""
    state = latest(spark, root)
    dates = None if frm is None else state.dates(name, *_micros(spark, frm, to))
    return state.read(spark, name, SPANS[name][0], dates)


def add_client_stops(rows: DataFrame, root: str) -> None:
    """Put client stops in the stored stop_events, in place of those with the same id on the same dates."""
    spark, state = rows.sparkSession, latest(rows.sparkSession, root)
    rows = materialise(_shaped(rows, schema.STOP_EVENTS).withColumn("source", F.lit("client")))
    dates = _dates(rows, "arrived_at")
    held = state.read(spark, "stop_events", schema.STOP_EVENTS, dates).join(rows.select("id"), "id", "left_anti")
    after = held.select(*rows.columns).unionByName(rows)
    commit(spark, state, {"stop_events": Change(after, dates, "arrived_at", "departed_at")})


def store_run(run: Derivation, root: str, frm, to, now) -> None:
    """Put a run in the tables trips, stop_events and matches under root, in place of what it recomputed.

    Derived trips and stops of the run's vehicles that touch [frm, to) are replaced, and so are the matches of
    these stops, of client stops that arrived in the window, and of every stop matched anew. Client stops stay.
    Only dates with rows that may touch the window are read. All three tables change in one commit: a reader sees
    the run before or this one, whole. Running the same derivation again gives the same tables.
    """
    spark = run.vehicles.sparkSession
    state = latest(spark, root)
    low, high = _micros(spark, frm, to)
    mine = run.vehicles.select("vehicle_id").distinct()
    derived = F.col("source") == "derived"
    tables, old, new, changes = {}, {}, {}, {}
    for name, rows in (("trips", run.trips), ("stop_events", run.stops)):
        ddl, start, end = SPANS[name]
        tables[name] = state.read(spark, name, ddl, state.dates(name, low, high))
        touching = tables[name].filter(derived & overlaps(start, end, frm, to, now))
        old[name] = materialise(touching.join(mine, "vehicle_id", "left_semi").select("id", start))
        new[name] = materialise(_shaped(rows, ddl).withColumn("source", F.lit("derived")))
        changes[name] = _changed(spark, state, name, "id", old[name], new[name])

    arrivals = run.client_stops.select(F.col("id").alias("client_event_id"), F.col("arrived_at").alias("client_arrived_at"))
    found = run.matches.join(arrivals, "client_event_id", "left").withColumn("matched_at", at(now))
    new_matches = materialise(_shaped(found, SPANS["matches"][0]))
    # Whatever these replace involves stops that arrived in the window or belong to a stop that touches it.
    reach = old["stop_events"].select("arrived_at").union(new["stop_events"].select("arrived_at")).union(new_matches.select("client_arrived_at"))
    edge = reach.agg(F.unix_micros(F.min("arrived_at")), F.unix_micros(F.max("arrived_at"))).first()
    near = state.dates("matches", min(low, edge[0] or low) - DAY_US, max(high, edge[1] or high) + DAY_US)
    matches = state.read(spark, "matches", SPANS["matches"][0], near)
    arrived = tables["stop_events"].filter((F.col("source") == "client") & in_window("arrived_at", frm, to)).join(mine, "vehicle_id", "left_semi")
    sides = {
        "client_event_id": arrived.select("id").union(new_matches.select("client_event_id")),
        "derived_event_id": old["stop_events"].select("id").union(new_matches.select("derived_event_id")),
    }
    gone = [matches.join(ids.toDF(side), side, "left_semi").select("client_event_id", "client_arrived_at") for side, ids in sides.items()]
    changes["matches"] = _changed(spark, state, "matches", "client_event_id", materialise(gone[0].union(gone[1])), new_matches)
    commit(spark, state, changes)


def _changed(spark, state, name: str, key: str, old: DataFrame, new: DataFrame) -> Change:
    """On the dates of the old and the new rows: what is there, without the old rows and with the new ones."""
    ddl, start, end = SPANS[name]
    dates = _dates(old.select(start).union(new.select(start)), start)
    kept = state.read(spark, name, ddl, dates).join(old.select(key), key, "left_anti")
    return Change(kept.select(*new.columns).unionByName(new), dates, start, end)


def _dates(rows: DataFrame, start: str) -> list:
    """The dates of rows: as many as a window touches."""
    return [r[0] for r in rows.select(utc_date(start).alias("d")).distinct().collect()]


def _micros(spark, *moments) -> list[int]:
    """Moments given in any form as microseconds."""
    row = spark.range(1).select(*[F.unix_micros(at(m).cast("timestamp")) for m in moments]).first()
    return list(row)


def _shaped(rows: DataFrame, ddl: str) -> DataFrame:
    """The columns of a table, NULL where rows have none."""
    columns = [c.split(" ") for c in ddl.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in columns])


def run_summary(run: Derivation) -> DataFrame:
    """One row over the fleet: vehicles, trips, stops of both sources, and matches."""
    parts = {
        "vehicles": run.vehicles,
        "trips": run.trips,
        "derived_stops": run.stops,
        "client_stops": run.client_stops,
        "matched": run.matches,
    }
    counted = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        counted = one if counted is None else counted.unionByName(one)
    totals = counted.agg(
        *[F.sum(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in parts]
    )
    return totals.withColumns(
        {
            "client_only": F.col("client_stops") - F.col("matched"),
            "derived_only": F.col("derived_stops") - F.col("matched"),
        }
    )
