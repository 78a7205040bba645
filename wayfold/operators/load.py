"""Idempotent loads: every function takes snapshots and returns the rows to write or a new snapshot."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.predicates import at, in_window, overlaps
from wayfold.operators.stops import event_id


def _known(existing: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Which of ids the existing table already holds. The batch is the side Spark may broadcast when
    it is small, so the table is streamed past it and not shuffled."""
    return existing.select(column).join(ids.select(column), column, "left_semi").distinct()


def first_writes(batch: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in `order`; combines map-side, so replays collapse before the shuffle."""
    ranked = F.struct(*order, *[c for c in batch.columns if c not in order])
    # The rank holds the whole row, so its least value is the row: nothing is carried twice.
    firsts = batch.groupBy(F.col(key).alias("_key")).agg(F.min(ranked).alias("r"))
    return firsts.select(*[F.col(f"r.{c}").alias(c) for c in batch.columns])


def new_positions(known: DataFrame, batch: DataFrame, order: tuple = ("received_at",)) -> DataFrame:
    """The first row of each reading_id of the batch that known does not have."""
    firsts = first_writes(batch, "reading_id", list(order))
    return firsts.join(known, "reading_id", "left_anti").select(*batch.columns)


def load_positions(
    existing: DataFrame, batch: DataFrame, order: tuple = ("received_at",)
) -> tuple[DataFrame, DataFrame]:
    """(rows to append, audit). The first write of a reading_id wins, in the batch and over time."""
    order = list(order)
    firsts = first_writes(batch, "reading_id", order)
    known = _known(existing, firsts, "reading_id")
    new_rows = firsts.join(known, "reading_id", "left_anti").select(*batch.columns)
    return new_rows, load_audit(batch, new_rows)


def load_audit(batch: DataFrame, new_rows: DataFrame) -> DataFrame:
    """One row: enqueued, inserted, duplicates."""
    offered = batch.select(F.lit(1).alias("e"), F.lit(0).alias("i"))
    stored = new_rows.select(F.lit(0).alias("e"), F.lit(1).alias("i"))
    total = offered.union(stored).agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("enqueued"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("inserted"),
    )
    return total.withColumn("duplicates", F.col("enqueued") - F.col("inserted"))


def collapse_by_id(batch: DataFrame, seq: str = "batch_seq") -> DataFrame:
    """One report per stop id: the first that carries a departure, else the first."""
    best = F.min_by(F.struct(*batch.columns), F.struct(F.col("departed_at").isNull(), F.col(seq)))
    return batch.groupBy(F.col("id").alias("_key")).agg(best.alias("r")).select("r.*")


def merge_client_stops(
    stops: DataFrame, batch: DataFrame, seq: str = "batch_seq"
) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, affected ids). New reports are inserted; a stored open stop takes the departure
    of a closed report and nothing else; every other report changes nothing."""
    reports = collapse_by_id(batch, seq)
    closing = reports.filter("departed_at is not null").select("id", F.col("departed_at").alias("_left"))
    joined = stops.join(closing, "id", "left")
    completes = F.col("departed_at").isNull() & F.col("_left").isNotNull()
    kept = joined.withColumn("departed_at", F.coalesce("departed_at", "_left"))
    inserted = reports.join(_known(stops, reports, "id"), "id", "left_anti")
    rows = inserted.withColumn("source", F.lit("client"))
    rows = rows.select(*[c for c in stops.columns if c in rows.columns])
    snapshot = kept.select(*stops.columns).unionByName(rows, allowMissingColumns=True)
    affected = inserted.select("id", F.lit("inserted").alias("change")).unionByName(
        joined.filter(completes).select("id", F.lit("closed").alias("change"))
    )
    return snapshot, affected


def resolve_stop_log(log: DataFrame, seq: str = "batch_seq") -> DataFrame:
    """The state merge_client_stops would reach, from an append-only log of collapsed batches: place
    and arrival of the first report, departure of the first one that has it."""
    others = [c for c in log.columns if c not in ("id", "departed_at", seq)]
    first = F.min_by(F.struct(*others), seq).alias("r")
    left = F.min_by("departed_at", F.when(F.col("departed_at").isNotNull(), F.col(seq)))
    return log.groupBy("id").agg(first, left.alias("departed_at")).select("id", "r.*", "departed_at")


def replace_derived(
    trips: DataFrame,
    stops: DataFrame,
    new_trips: DataFrame,
    new_stops: DataFrame,
    frm,
    to,
    now,
    vehicles: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trips, stops) with the derived rows touching [frm, to) replaced; client rows are kept.
    With `vehicles`, only rows of those vehicles are replaced."""
    kept_trips = _outside(trips, "started_at", "ended_at", frm, to, now, vehicles)
    kept_stops = _outside(stops, "arrived_at", "departed_at", frm, to, now, vehicles)
    return (
        kept_trips.unionByName(new_trips, allowMissingColumns=True),
        kept_stops.unionByName(new_stops, allowMissingColumns=True),
    )


def _outside(table, start, end, frm, to, now, vehicles):
    replaced = (F.col("source") == "derived") & overlaps(start, end, frm, to, now)
    if vehicles is None:
        return table.filter(~replaced)
    mine = vehicles.select("vehicle_id").distinct().withColumn("_mine", F.lit(True))
    marked = table.join(mine, "vehicle_id", "left")
    return marked.filter(~(replaced & F.col("_mine").isNotNull())).select(*table.columns)


def drop_orphan_matches(matches: DataFrame, stops: DataFrame) -> DataFrame:
    """Matches whose two stops still exist."""
    ids = stops.select("id")
    for side in ("client_event_id", "derived_event_id"):
        matches = matches.join(ids.withColumnRenamed("id", side), side, "left_semi")
    return matches


def replace_matches(
    matches: DataFrame, stops: DataFrame, new_matches: DataFrame, frm, to, vehicles: DataFrame | None = None
) -> DataFrame:
    """Replace the matches whose client stop arrived in [frm, to). A stop has one match, so old matches of a
    stop that is matched anew go too, wherever the other stop lies."""
    window = stops.filter(in_window("arrived_at", frm, to))
    if vehicles is not None:
        window = window.join(vehicles.select("vehicle_id"), "vehicle_id", "left_semi")
    gone = window.select(F.col("id").alias("client_event_id"))
    kept = matches.join(gone, "client_event_id", "left_anti")
    for side in ("client_event_id", "derived_event_id"):
        kept = kept.join(new_matches.select(side), side, "left_anti")
    kept = kept.select(*matches.columns)
    return kept.unionByName(new_matches, allowMissingColumns=True)


def new_vehicles(vehicles: DataFrame, batches: DataFrame, created_at) -> DataFrame:
    """A row for every device_id the vehicle table does not know yet, labelled with it."""
    seen = batches.select(F.col("device_id").alias("external_id")).filter("external_id <> ''").distinct()
    unknown = seen.join(_known(vehicles, seen, "external_id"), "external_id", "left_anti")
    return unknown.select(
        event_id("vehicle", F.col("external_id")).alias("id"),
        "external_id",
        F.col("external_id").alias("label"),
        at(created_at).alias("created_at"),
    )


def register_vehicles(vehicles: DataFrame, batches: DataFrame, created_at) -> DataFrame:
    """The vehicle table with the new devices added."""
    return vehicles.unionByName(new_vehicles(vehicles, batches, created_at))


def retain_since(positions: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """(positions recorded at or after cutoff, one row counting the dropped ones)."""
    old = F.col("recorded_at") < at(cutoff)
    return positions.filter(~old), positions.agg(F.count_if(old).alias("dropped"))
