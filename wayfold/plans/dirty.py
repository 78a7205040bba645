"""Derive again only what late rows can have changed: per vehicle, from the nearest cut before them to the nearest after.

A cut is a sample that comes after a gap longer than trips bridge and more than twice the stop radius away from the sample
before it. No stop and no trip reaches over it, so what lies on its two sides is derived as if the other were not there.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.config import DetectConfig
from wayfold.functions.predicates import at
from wayfold.operators.ordered import Slicing, resolve_slicing
from wayfold.operators.stops import KEYS
from wayfold.operators.trips import detect, link_stops, with_steps
from wayfold.session import materialise


def dirty_ranges(positions: DataFrame, since, cfg: DetectConfig = DetectConfig(), slicing: Slicing | None = None) -> DataFrame:
    """(vehicle_id, from_us, to_us) of each vehicle with rows received at or after since; NULL where no cut bounds it.

    Both cuts lie between rows that were there before, so they were cuts of the earlier derivation too.
    """
    rows = positions.join(
        positions.filter(F.col("received_at") >= at(since)).groupBy(*KEYS).agg(
            F.unix_micros(F.min("recorded_at")).alias("_first"), F.unix_micros(F.max("recorded_at")).alias("_last")
        ), KEYS,
    )
    steps = with_steps(rows, resolve_slicing(rows, KEYS, "recorded_at", slicing))
    now = F.unix_micros("recorded_at")
    before = now - F.round(F.col("gap_seconds") * 1e6).cast("bigint")
    cut = (F.col("gap_seconds") > cfg.trip_gap_seconds) & (F.col("step_m") > 2 * cfg.stop_radius_m * (1 + 1e-9))
    return steps.groupBy(*KEYS).agg(
        F.max(F.when(cut & (now < F.col("_first")), now)).alias("from_us"),
        F.min(F.when(cut & (before > F.col("_last")), now)).alias("to_us"),
    )


def _within(start: str):
    """The row starts in its vehicle's range."""
    us = F.unix_micros(start)
    return (F.coalesce(us >= F.col("from_us"), F.lit(True))) & (F.coalesce(us < F.col("to_us"), F.lit(True)))


def rederive(
    positions: DataFrame, trips: DataFrame, stops: DataFrame, ranges: DataFrame, cfg: DetectConfig = DetectConfig(), slicing: Slicing | None = None
) -> tuple[DataFrame, DataFrame]:
    """(trips, stops) of all vehicles after their ranges have been derived again; equal to deriving everything.

    trips and stops are what was derived before. Only samples inside the ranges are walked; the arriving trips of dirty
    vehicles' stops are looked up anew, since a trip of the range may be the last one before a later stop.
    """
    ranges = materialise(ranges)
    # The sample of the upper cut closes what the range leaves open, and starts nothing by itself.
    us = F.unix_micros("recorded_at")
    inside = F.coalesce(us >= F.col("from_us"), F.lit(True)) & F.coalesce(us <= F.col("to_us"), F.lit(True))
    samples = positions.join(ranges, KEYS).filter(inside).drop("from_us", "to_us")
    new_trips, new_stops = detect(samples, cfg, slicing)

    def merged(old: DataFrame, new: DataFrame, start: str) -> tuple[DataFrame, DataFrame]:
        """Rows of other vehicles, and those of dirty ones: old outside their range, new within."""
        names = [c for c in new.columns if c in old.columns]
        mine = old.join(ranges, KEYS).filter(~_within(start)).select(*names)
        fresh = new.join(ranges, KEYS).filter(_within(start)).select(*names)
        return old.join(ranges, KEYS, "left_anti").select(*names), materialise(mine.unionByName(fresh))

    clean_trips, dirty_trips = merged(trips, new_trips, "started_at")
    clean_stops, dirty_stops = merged(stops, new_stops, "arrived_at")
    linked = link_stops(dirty_stops, dirty_trips, slicing)
    return clean_trips.unionByName(dirty_trips), clean_stops.unionByName(linked.select(*clean_stops.columns))
