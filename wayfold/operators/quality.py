"""Table constraints as reports of the rows that break them."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.config import MOTION_STATES, SOURCES


def _broken(table: str, df: DataFrame, row_id, rules: dict) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(holds, F.lit(rule)) for rule, holds in rules.items()]))
    return df.select(F.lit(table).alias("table"), row_id.alias("row_id"), F.explode(names).alias("rule"))


def _orphans(table, df, row_id, column, parent, parent_id, rule):
    keys = parent.select(F.col(parent_id).alias(column))
    lost = df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")
    return lost.select(F.lit(table).alias("table"), row_id.alias("row_id"), F.lit(rule).alias("rule"))


def _place():
    return {
        "lat_range": ~F.col("lat").between(-90, 90),
        "lon_range": ~F.col("lon").between(-180, 180),
    }


def constraint_violations(
    positions: DataFrame, trips: DataFrame, stops: DataFrame, matches: DataFrame, vehicles: DataFrame
) -> DataFrame:
    """(table, row_id, rule) for every broken constraint; a NULL optional value breaks none."""
    match_id = F.concat_ws("|", "client_event_id", "derived_event_id")
    reports = [
        _broken(
            "positions",
            positions,
            F.col("reading_id"),
            {
                **_place(),
                "battery_range": ~F.col("battery_pct").between(0, 100),
                "heading_range": ~F.col("heading_deg").between(0, 360),
                "motion_state": ~F.col("motion_state").isin(*MOTION_STATES),
            },
        ),
        _broken(
            "trips",
            trips,
            F.col("id"),
            {
                "source": ~F.col("source").isin(*SOURCES),
                "ended_after_started": F.col("ended_at") < F.col("started_at"),
                "distance_non_negative": F.col("distance_m") < 0,
            },
        ),
        _broken(
            "stop_events",
            stops,
            F.col("id"),
            {
                **_place(),
                "source": ~F.col("source").isin(*SOURCES),
                "departed_after_arrived": F.col("departed_at") < F.col("arrived_at"),
            },
        ),
        _broken(
            "stop_event_matches",
            matches,
            match_id,
            {"distinct_events": F.col("client_event_id") == F.col("derived_event_id")},
        ),
        _orphans("positions", positions, F.col("reading_id"), "vehicle_id", vehicles, "id", "vehicle_exists"),
        _orphans("trips", trips, F.col("id"), "vehicle_id", vehicles, "id", "vehicle_exists"),
        _orphans("stop_events", stops, F.col("id"), "vehicle_id", vehicles, "id", "vehicle_exists"),
        _orphans("stop_events", stops, F.col("id"), "trip_id", trips, "id", "trip_exists"),
        _orphans("stop_event_matches", matches, match_id, "client_event_id", stops, "id", "client_exists"),
        _orphans("stop_event_matches", matches, match_id, "derived_event_id", stops, "id", "derived_exists"),
    ]
    return reduce(DataFrame.unionByName, reports)


def multiple_open_trips(trips: DataFrame) -> DataFrame:
    """(vehicle_id, source, open_trips) where more than one trip is open."""
    open_trips = trips.filter("ended_at is null").groupBy("vehicle_id", "source")
    return open_trips.agg(F.count(F.lit(1)).alias("open_trips")).filter("open_trips > 1")
