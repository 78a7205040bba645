"""Trips between stops, the link from a stop to the trip that reached it, and the composed pass."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.config import DetectConfig
from wayfold.functions.geo import haversine_m
from wayfold.operators.ordered import (
    SLICE,
    Slicing,
    carry_in,
    earlier_slices,
    fill_forward,
    inside_slice,
    resolve_slicing,
    with_previous,
)
from wayfold.operators.stops import KEYS, detect_stops, event_id
from wayfold.session import materialise

ORDER = ["recorded_at", "reading_id"]


def with_steps(positions: DataFrame, slicing: Slicing | None = None) -> DataFrame:
    """Add gap_seconds, step_m and step_mps from the previous sample of the vehicle (NULL on the first)."""
    slicing = resolve_slicing(positions, KEYS, "recorded_at", slicing)
    out = with_previous(
        positions, KEYS, "recorded_at", ORDER, ["recorded_at", "lat", "lon"], slicing
    )
    gap = (F.unix_micros("recorded_at") - F.unix_micros("prev.recorded_at")) / 1e6
    return (
        out.withColumn("gap_seconds", gap)
        .withColumn("step_m", haversine_m("prev.lat", "prev.lon", "lat", "lon"))
        .withColumn("step_mps", F.when(F.col("gap_seconds") > 0, F.col("step_m") / F.col("gap_seconds")))
        .drop("prev")
    )


def mark_parked(positions: DataFrame, stops: DataFrame, slicing: Slicing) -> DataFrame:
    """Add _slice and `parked`: the sample lies inside a stop's span, both ends included.

    Spans of one vehicle are disjoint, so the span that starts last is the only one that can hold a
    sample. Each span is one row where it starts, found by a running `last`; a slice gets the last
    span of the slices before it, however long that lasts.
    """
    # Stated on both inputs, so that the branches of detect_trips share one shuffle.
    known = F.col("vehicle_id").isNotNull()
    spans = stops.filter(known).select(
        *KEYS,
        F.col("arrived_at").alias("_at"),
        F.unix_micros("arrived_at").alias("_us"),
        F.struct(F.unix_micros("arrived_at").alias("_start"), F.unix_micros("departed_at").alias("_end")).alias("_span"),
    )
    samples = positions.filter(known).select(
        *KEYS, F.col("recorded_at").cast("timestamp").alias("_at"), F.unix_micros("recorded_at").alias("_us"), "reading_id", "lat", "lon"
    )
    both = slicing.attach(samples.unionByName(spans, allowMissingColumns=True), KEYS, "_at")
    # At one instant a span's start precedes the samples taken then.
    order = ["_us", F.col("reading_id").asc_nulls_first()]
    latest = F.last("_span", ignorenulls=True).over(inside_slice(KEYS, order))
    if slicing.whole:
        both = both.withColumn("_span", latest)
    else:
        last = F.max("_span").alias("_last")
        carried = F.last("_last", ignorenulls=True).over(earlier_slices(KEYS)).alias("_before")
        both = carry_in(both, KEYS, [last], [carried]).withColumn("_span", F.coalesce(latest, "_before"))
    return (
        both.filter("reading_id is not null")
        .withColumn("parked", F.col("_span").isNotNull() & F.coalesce(F.col("_us") <= F.col("_span._end"), F.lit(True)))
        .select(*KEYS, SLICE, "_us", "reading_id", "lat", "lon", "parked")
    )


def detect_trips(
    positions: DataFrame,
    stops: DataFrame,
    cfg: DetectConfig = DetectConfig(),
    slicing: Slicing | None = None,
) -> DataFrame:
    """Trips: runs of samples outside every stop, split at gaps over trip_gap_seconds, of two or
    more samples. Returns (id, vehicle_id, source, started_at, ended_at, distance_m)."""
    slicing = resolve_slicing(positions, KEYS, "recorded_at", slicing)
    order = ["_us", "reading_id"]
    window = inside_slice(KEYS, order)
    seen = F.struct("_us", "lat", "lon", "parked")
    rows = mark_parked(positions, stops, slicing).withColumn("_prev", F.lag(seen).over(window))
    gap_us = int(cfg.trip_gap_seconds * 1_000_000)

    def breaks(us, parked, prev):
        """A moving sample that cannot continue the trip of the sample before it."""
        before = F.col(prev)
        fresh = before.isNull() | before["parked"] | (us - before["_us"] > gap_us)
        return ~parked & fresh

    if slicing.whole:
        before = F.col("_prev")
        starts = breaks(F.col("_us"), F.col("parked"), "_prev")
        rows = rows.withColumn("_before", before)
        rows = rows.withColumn("_start", F.when(starts, F.col("_us")))
        rows = rows.withColumn("_trip", F.last("_start", ignorenulls=True).over(window))
    else:
        # What a slice hands on: its last sample, and the start of its last trip. Whether its first
        # sample starts a trip depends on the slice before, so that is settled on the summary rows.
        local = F.when(
            F.col("_prev").isNotNull() & breaks(F.col("_us"), F.col("parked"), "_prev"), F.col("_us")
        )
        rows = rows.withColumn("_local", local)
        summary = [
            F.min_by(F.struct("_us", "parked"), F.struct(*order)).alias("_first"),
            F.max_by(seen, F.struct(*order)).alias("_last"),
            F.max("_local").alias("_lastlocal"),
        ]
        prior = F.last("_last").over(earlier_slices(KEYS))
        per_slice = rows.groupBy(*KEYS, SLICE).agg(*summary).withColumn("_prior", prior)
        first_starts = breaks(F.col("_first._us"), F.col("_first.parked"), "_prior")
        per_slice = per_slice.withColumn("_head", F.when(first_starts, F.col("_first._us")))
        handed = F.last(F.coalesce("_lastlocal", "_head"), ignorenulls=True).over(earlier_slices(KEYS))
        carried = per_slice.select(*KEYS, SLICE, "_prior", "_head", handed.alias("_handed"))
        rows = rows.join(carried, [*KEYS, SLICE], "left")
        rows = rows.withColumn("_before", F.coalesce("_prev", "_prior"))
        start = F.coalesce("_local", F.when(F.col("_prev").isNull(), F.col("_head")))
        rows = rows.withColumn("_start", start)
        inside = F.last("_start", ignorenulls=True).over(window)
        rows = rows.withColumn("_trip", F.coalesce(inside, F.col("_handed")))

    step = haversine_m("_before.lat", "_before.lon", "lat", "lon")
    hop = F.when(F.col("_start").isNotNull(), F.lit(0.0)).otherwise(step)
    trips = (
        rows.filter(~F.col("parked"))
        .groupBy(*KEYS, "_trip")
        .agg(
            F.min("_us").alias("_from"),
            F.max("_us").alias("_to"),
            F.count(F.lit(1)).alias("_n"),
            F.sum(hop).alias("distance_m"),
        )
        .filter("_n >= 2")
    )
    return trips.select(
        event_id("trip", F.col("vehicle_id"), F.col("_from")).alias("id"),
        "vehicle_id",
        F.lit("derived").alias("source"),
        F.timestamp_micros("_from").alias("started_at"),
        F.timestamp_micros("_to").alias("ended_at"),
        "distance_m",
    )


def link_stops(stops: DataFrame, trips: DataFrame, slicing: Slicing | None = None) -> DataFrame:
    """Add trip_id: the latest trip of the vehicle that ended at or before the stop's arrival.

    An as-of join as one ordered pass over both tables. Of trips ending at one instant the earliest
    started wins.
    """
    ended = trips.filter("ended_at is not null").select(
        *KEYS,
        F.col("ended_at").alias("_at"),
        F.lit(0).alias("_kind"),
        F.struct(F.unix_micros("started_at").alias("s"), F.col("id").alias("trip")).alias("_t"),
    )
    arrived = stops.drop("trip_id").withColumn("_at", F.col("arrived_at")).withColumn("_kind", F.lit(1))
    both = arrived.unionByName(ended, allowMissingColumns=True)
    both = both.withColumn("_rank", -F.coalesce(F.col("_t.s"), F.lit(0)))
    both = both.withColumn("_tie", F.coalesce("id", F.col("_t.trip")))
    if slicing is None:
        slicing = resolve_slicing(both, KEYS, "_at", None)
    order = ["_at", "_kind", "_rank", "_tie"]
    filled = fill_forward(both, KEYS, "_at", order, "_t", slicing, "_latest")
    return (
        filled.filter("_kind = 1")
        .withColumn("trip_id", F.col("_latest.trip"))
        .select(*[c for c in stops.columns if c != "trip_id"], "trip_id")
    )


def detect(
    positions: DataFrame, cfg: DetectConfig = DetectConfig(), slicing: Slicing | None = None
) -> tuple[DataFrame, DataFrame]:
    """(trips, stops) of every vehicle. Stops are far fewer than samples and are used three times,
    so they are written once to the checkpoint folder."""
    slicing = resolve_slicing(positions, KEYS, "recorded_at", slicing)
    samples = positions.select(*KEYS, *ORDER, "lat", "lon")
    stops = materialise(detect_stops(samples, cfg, slicing))
    trips = detect_trips(samples, stops, cfg, slicing)
    return trips, link_stops(stops, trips, slicing)

