"""Micro-batch ingest: JSON batches to position, stop-log, vehicle, rejection and audit tables."""

import json
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfold import schema
from wayfold.functions.validation import accepted_rows, reading_reason, stop_reason
from wayfold.operators.load import (
    collapse_by_id,
    load_audit,
    new_positions,
    new_vehicles,
)
from wayfold.session import materialise
from wayfold.sources import stoplog
from wayfold.sources.batches import REJECTIONS, answer_batches, batch_readings, batch_stops, judge_batches, rejections, with_vehicle_ids
from wayfold.sources.idindex import IdIndex
from wayfold.sources.tables import DATE, append_positions, children, exists, read_table, remove, utc_date

AUDIT = (
    "enqueued bigint, inserted bigint, duplicates bigint, refused bigint, flushes bigint, failures bigint, "
    "stream string, epoch bigint, seq bigint, load string"
)
ANSWERS = (
    "device_id string, sent_at timestamp, received_at timestamp, reason string, accepted bigint, accepted_stops bigint, "
    f"rejected {REJECTIONS}, rejected_stops {REJECTIONS}, load string"
)
CLAIM = "seq bigint, load string"
ATTEMPT = "begun timestamp, load string"
_TURNS: dict[str, threading.Lock] = {}


@dataclass(frozen=True)
class Target:
    """Folder holding the tables the stream writes. Loads of one target take turns; streams of one driver wait for each other."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def turn(self) -> threading.Lock:
        return _TURNS.setdefault(self.root, threading.Lock())


def ingest_batch(target: Target, batches: DataFrame, epoch: int, received_at=None, stream: str | None = None) -> None:
    """Load one micro-batch, once for each (stream, epoch).

    stream names who counts the epochs: a query's checkpoint. Another stream's epoch, or the same number under a new
    checkpoint, is another load. Without a name every call is one of its own. Whatever the load, an id that the target
    holds is not stored again. A load that was cut off goes on where it stopped; one that is complete does nothing.
    """
    with target.turn():
        _load(target, batches, epoch, received_at, stream or uuid.uuid4().hex)


def _load(target: Target, batches: DataFrame, epoch: int, received_at, stream: str) -> None:
    spark, load = batches.sparkSession, f"{stream}-{epoch}"
    if exists(spark, f"{target.path('audit')}/load={load}/_SUCCESS"):
        return
    _put(spark.createDataFrame([(None,)], "begun timestamp").select(F.current_timestamp().alias("begun")), target, "attempts", load, "append")
    seq = _place_in_order(spark, target, load)
    now = F.current_timestamp() if received_at is None else received_at
    arrived = materialise(batches.withColumn("received_at", now))
    usable, _ = judge_batches(arrived)
    arrival = F.col("received_at")

    # Of the vehicle table only the rows of devices that report in this batch are kept.
    devices = usable.select(F.col("device_id").alias("external_id")).distinct()
    vehicles = read_table(spark, target.path("vehicles"), schema.VEHICLES)
    mine = materialise(vehicles.join(devices, "external_id", "left_semi").select(*vehicles.columns))
    added = materialise(new_vehicles(mine, usable, F.current_timestamp()))
    added.write.mode("append").parquet(target.path("vehicles"))
    known = mine.unionByName(added)
    readings = accepted_rows(with_vehicle_ids(batch_readings(usable), known), reading_reason, arrival)
    reports = accepted_rows(with_vehicle_ids(batch_stops(usable), known), stop_reason, arrival)

    columns = [c.split(" ")[0] for c in schema.POSITIONS.split(", ")]
    batch = materialise(readings.select(*columns, "batch_seq"))
    # Another load that was cut off while it stored its rows: its ids must be known before this one looks.
    for other in children(spark, target.path("staged")):
        if other != f"load={load}" and exists(spark, f"{target.path('staged')}/{other}/_SUCCESS"):
            _store(spark, target, other.removeprefix("load="), True)
    # What this load adds is settled once; if an earlier attempt has settled it, part of it may be stored already.
    staged = f"{target.path('staged')}/load={load}"
    again = exists(spark, f"{staged}/_SUCCESS")
    if not again:
        known_ids = IdIndex(spark, target.path("index")).known(batch.select("reading_id")).withColumnRenamed("id", "reading_id")
        settled = new_positions(known_ids, batch, ("received_at", "batch_seq")).select(*columns)
        settled.write.mode("overwrite").parquet(staged)
    new_rows = _store(spark, target, load, again)

    log = reports.withColumnRenamed("event_id", "id").select(*[c.split(" ")[0] for c in stoplog.STOP_LOG.split(", ")])
    _put(collapse_by_id(log).withColumn("batch_seq", F.lit(seq).cast("bigint")), target, "stop_log", load)
    # The answers name all that is refused, so no other pass over the batches looks for it.
    _put(answer_batches(arrived, ["device_id", "sent_at", "received_at"]), target, "answers", load)
    answers = read_answers(spark, target).where(F.col("load") == load)
    refused = answers.where("reason IS NOT NULL").select(F.lit("batch").alias("kind"), F.col("device_id").alias("id"), "reason")
    rejected = materialise(rejections(answers, []).unionByName(refused))
    _put(rejected, target, "rejected", load)

    attempts = read_table(spark, target.path("attempts"), ATTEMPT).where(F.col("load") == load).count()
    told = load_audit(batch, new_rows).select("enqueued", "inserted", "duplicates").withColumns(
        {
            "refused": F.lit(rejected.count()).cast("long"),
            "flushes": (F.col("inserted") > 0).cast("long"),
            "failures": F.lit(attempts - 1).cast("long"),
            "stream": F.lit(stream),
            "epoch": F.lit(epoch).cast("long"),
            "seq": F.lit(seq).cast("long"),
        }
    )
    # The last write: from now on the load is complete.
    _put(told, target, "audit", load)
    remove(spark, staged)
    IdIndex(spark, target.path("index")).compact()


def _store(spark: SparkSession, target: Target, load: str, again: bool) -> DataFrame:
    """Append the rows that a load has staged, and tell the index of their ids; returns these rows."""
    rows = spark.read.schema(schema.POSITIONS).parquet(f"{target.path('staged')}/load={load}")
    append_positions(materialise(_not_stored(spark, target, rows)) if again else rows, target.path("positions"))
    IdIndex(spark, target.path("index")).add(rows.select("reading_id"), load)
    return rows


def _put(rows: DataFrame, target: Target, name: str, load: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(f"{target.path(name)}/load={load}")


def _place_in_order(spark: SparkSession, target: Target, load: str) -> int:
    """The load's place among all loads of the target, the same in every attempt."""
    claims = read_table(spark, target.path("claims"), CLAIM)
    row = claims.agg(F.max("seq").alias("last"), F.max(F.when(F.col("load") == load, F.col("seq"))).alias("own")).first()
    if row["own"] is not None:
        return row["own"]
    seq = 0 if row["last"] is None else row["last"] + 1
    _put(spark.createDataFrame([(seq,)], "seq bigint"), target, "claims", load)
    return seq


def _not_stored(spark: SparkSession, target: Target, rows: DataFrame) -> DataFrame:
    """Rows whose id the positions of their own dates do not hold."""
    if not exists(spark, target.path("positions")):
        return rows
    dated = rows.withColumn(DATE, utc_date("recorded_at"))
    dates = [r[0] for r in dated.select(DATE).distinct().collect()]
    stored = spark.read.schema(f"{schema.POSITIONS}, {DATE} date").parquet(target.path("positions")).filter(F.col(DATE).isin(dates))
    return dated.join(stored.select(DATE, "reading_id"), [DATE, "reading_id"], "left_anti").select(*rows.columns)


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The identity that a query's checkpoint keeps over restarts."""
    raw = spark.read.text(f"{checkpoint}/metadata").first()[0]
    return json.loads(raw)["id"]


def start_ingest(
    batches: DataFrame,
    target: Target,
    checkpoint: str,
    trigger: dict | None = None,
    received_at=None,
) -> StreamingQuery:
    """Load a stream of batches; bound a micro-batch with maxFilesPerTrigger on the source."""

    def run(df: DataFrame, epoch: int) -> None:
        ingest_batch(target, df, epoch, received_at, stream_name(df.sparkSession, checkpoint))

    return (
        batches.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def load_counters(spark: SparkSession, target: Target) -> DataFrame:
    """A row for each stream: loads, enqueued, inserted, duplicates, refused, flushes and failures so far."""
    audit = read_table(spark, target.path("audit"), AUDIT)
    names = ["enqueued", "inserted", "duplicates", "refused", "flushes", "failures"]
    return audit.groupBy("stream").agg(F.count(F.lit(1)).alias("loads"), *[F.sum(n).alias(n) for n in names])


def read_answers(spark: SparkSession, target: Target) -> DataFrame:
    """What each batch was answered, by device and the time it was sent."""
    return read_table(spark, target.path("answers"), ANSWERS)


def read_client_stops(spark: SparkSession, target: Target) -> DataFrame:
    """Client stops as the log leaves them."""
    stops = stoplog.read_stops(spark, target.path("stop_log"), target.path("stop_state"))
    return stops.drop("first_seq", "left_seq").withColumn("source", F.lit("client"))


def compact_client_stops(spark: SparkSession, target: Target) -> int:
    """Fold the stop log into its state, beside running loads; returns how many loads were folded."""
    return stoplog.compact(spark, target.path("stop_log"), target.path("stop_state"))
