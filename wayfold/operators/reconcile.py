"""Pair device-reported stops with derived ones and measure how far they disagree."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.config import DetectConfig
from wayfold.functions.geo import haversine_m
from wayfold.functions.predicates import in_window
from wayfold.operators.ordered import DAY_US, SLICE, Slicing, carry_in, earlier_slices, fill_forward, inside_slice
from wayfold.operators.stops import KEYS


def match_candidates(
    client: DataFrame, derived: DataFrame, cfg: DetectConfig = DetectConfig()
) -> DataFrame:
    """Every client/derived pair of one vehicle within both tolerances, with its score.

    The time band is an equi-join: buckets as wide as the tolerance, each derived stop laid into its
    own bucket and both neighbours. Derived stops of a vehicle arrive at least a minimum dwell
    apart, so with the default thresholds a client stop meets at most three of them and the result
    stays linear in the client stops, also for a vehicle that owns a large share of them.
    """
    width = max(int(cfg.match_max_seconds * 1_000_000), 1)
    c = client.select(
        "vehicle_id",
        F.col("id").alias("client_event_id"),
        F.unix_micros("arrived_at").alias("client_us"),
        F.col("lat").alias("_clat"),
        F.col("lon").alias("_clon"),
    ).withColumn("_bucket", F.expr(f"client_us div {width}L"))
    d = derived.select(
        "vehicle_id",
        F.col("id").alias("derived_event_id"),
        F.unix_micros("arrived_at").alias("derived_us"),
        F.col("lat").alias("_dlat"),
        F.col("lon").alias("_dlon"),
    ).withColumn(
        "_bucket", F.explode(F.expr(f"sequence(derived_us div {width}L - 1, derived_us div {width}L + 1)"))
    )
    seconds = (F.col("client_us") - F.col("derived_us")) / 1e6
    pairs = (
        c.join(d, ["vehicle_id", "_bucket"])
        .withColumn("_seconds", seconds)
        .filter(F.abs("_seconds") <= cfg.match_max_seconds)
        .withColumn("delta_meters", haversine_m("_clat", "_clon", "_dlat", "_dlon"))
        .filter(F.col("delta_meters") <= cfg.match_max_m)
    )
    score = F.abs("_seconds") / cfg.match_max_seconds + F.col("delta_meters") / cfg.match_max_m
    return pairs.select(
        "vehicle_id",
        "client_event_id",
        "derived_event_id",
        "client_us",
        "derived_us",
        F.round("_seconds").cast("int").alias("delta_seconds"),
        "delta_meters",
        score.alias("score"),
    )


def greedy_match(candidates: DataFrame) -> DataFrame:
    """One-to-one pairs taken in ascending (score, client order, derived order).

    Pairs that share a stop overlap in time, so a stretch of a vehicle's time that no pair reaches over parts the pairs
    into components that cannot compete. Each is settled by itself, best pair first, all in one pass: the number of passes
    does not depend on the data. Where stretches end is found by day slices, so a busy vehicle is not one task's work.
    """
    day, order = Slicing(DAY_US), ["_from", "_to", "client_event_id", "derived_event_id"]
    pairs = candidates.withColumns({"_from": F.least("client_us", "derived_us"), "_to": F.greatest("client_us", "derived_us")})
    pairs = pairs.withColumn("_at", F.timestamp_micros("_from"))
    sliced = day.attach(pairs, KEYS, "_at")
    earlier = F.max("_to").over(inside_slice(KEYS, order).rowsBetween(Window.unboundedPreceding, -1))
    reached = F.max("_last").over(earlier_slices(KEYS)).alias("_before")
    sliced = carry_in(sliced.withColumn("_earlier", earlier), KEYS, [F.max("_to").alias("_last")], [reached])
    apart = F.coalesce(F.greatest("_earlier", "_before") < F.col("_from"), F.lit(True))
    marked = sliced.withColumn("_opens", F.when(apart, F.col("_from"))).drop(SLICE, "_earlier", "_before")
    grouped = fill_forward(marked, KEYS, "_at", order, "_opens", day, "_component")
    rank = ["score", "client_us", "client_event_id", "derived_us", "derived_event_id"]
    placed = grouped.repartition(*KEYS, "_component").sortWithinPartitions(*KEYS, "_component", *rank)
    names = ["vehicle_id", "client_event_id", "derived_event_id", "delta_seconds", "delta_meters"]

    def settle(batches):
        held, taken = None, set()
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            keep = []
            for row, (vehicle, component, client, derived) in enumerate(zip(*columns)):
                if held != (vehicle, component):
                    held, taken = (vehicle, component), set()
                if ("c", client) not in taken and ("d", derived) not in taken:
                    taken.update((("c", client), ("d", derived)))
                    keep.append(row)
            yield batch.select(names).take(pa.array(keep, pa.int64()))

    rows = placed.select("vehicle_id", "_component", "client_event_id", "derived_event_id", "delta_seconds", "delta_meters")
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(settle, kinds)


def reconcile(client: DataFrame, derived: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    return greedy_match(match_candidates(client, derived, cfg))


def matched_in_window(matches: DataFrame, stops: DataFrame, frm, to) -> DataFrame:
    """Matches whose client stop arrived in [frm, to)."""
    clients = stops.filter(in_window("arrived_at", frm, to)).select(F.col("id").alias("client_event_id"))
    return matches.join(clients, "client_event_id", "left_semi")


def unmatched(stops: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Stops of one side ('client' or 'derived') that no match names."""
    if side not in ("client", "derived"):
        raise ValueError("side must be client or derived")
    named = matches.select(F.col(f"{side}_event_id").alias("id"))
    return stops.filter(F.col("source") == side).join(named, "id", "left_anti")


def reconciliation_summary(stops: DataFrame, matches: DataFrame, frm, to) -> DataFrame:
    """One row over the fleet: counts by arrival in [frm, to), mean absolute and signed seconds and
    mean metres of the matches (0 when there are none). A derived stop counts as matched only
    through a client stop inside the window."""
    windowed = stops.filter(in_window("arrived_at", frm, to)).select("id", "source")
    clients = windowed.filter("source = 'client'").select(F.col("id").alias("client_event_id"))
    inside = matches.join(clients, "client_event_id", "left_semi")
    named = inside.select(F.explode(F.array("client_event_id", "derived_event_id")).alias("id"))
    marked = windowed.join(named.distinct().withColumn("_hit", F.lit(True)), "id", "left")
    is_client, is_derived = F.col("source") == "client", F.col("source") == "derived"
    miss = F.col("_hit").isNull()
    counted = marked.agg(
        F.count_if(is_client).alias("client_stops"),
        F.count_if(is_derived).alias("derived_stops"),
        F.count_if(is_client & miss).alias("client_only"),
        F.count_if(is_derived & miss).alias("derived_only"),
    )
    means = _means(inside.agg(*_mean_aggs()))
    # Two one-row results.
    return counted.withColumn("_one", F.lit(1)).join(means.withColumn("_one", F.lit(1)), "_one").select(
        "client_stops", "derived_stops", "matched", "client_only", "derived_only",
        "mean_abs_delta_seconds", "mean_signed_delta_seconds", "mean_delta_meters",
    )


def _mean_aggs():
    return [
        F.count(F.lit(1)).alias("matched"),
        F.avg(F.abs("delta_seconds")).alias("mean_abs_delta_seconds"),
        F.avg("delta_seconds").alias("mean_signed_delta_seconds"),
        F.avg("delta_meters").alias("mean_delta_meters"),
    ]


def _means(df):
    means = ("mean_abs_delta_seconds", "mean_signed_delta_seconds", "mean_delta_meters")
    return df.withColumns({m: F.coalesce(F.col(m), F.lit(0.0)) for m in means})


def agreement(stops: DataFrame, matches: DataFrame) -> DataFrame:
    """Per vehicle: stops of both sources, matches, and the mean disagreement of the matches."""
    counts = stops.groupBy("vehicle_id").agg(
        F.count_if(F.col("source") == "client").alias("client_stops"),
        F.count_if(F.col("source") == "derived").alias("derived_stops"),
    )
    if "vehicle_id" not in matches.columns:
        owner = stops.select(F.col("id").alias("client_event_id"), "vehicle_id")
        matches = matches.join(owner, "client_event_id")
    per_vehicle = matches.groupBy("vehicle_id").agg(*_mean_aggs())
    joined = counts.join(per_vehicle, "vehicle_id", "left")
    joined = _means(joined.withColumn("matched", F.coalesce("matched", F.lit(0))))
    return joined.select(
        "vehicle_id",
        "client_stops",
        "derived_stops",
        "matched",
        (F.col("client_stops") - F.col("matched")).alias("client_only"),
        (F.col("derived_stops") - F.col("matched")).alias("derived_only"),
        "mean_abs_delta_seconds",
        "mean_signed_delta_seconds",
        "mean_delta_meters",
    )


def all_stops(client: DataFrame, derived: DataFrame) -> DataFrame:
    """Both sources in one table; neither replaces the other."""
    return client.unionByName(derived, allowMissingColumns=True)
