"""Telemetry batches as JSON lines: reading them, taking them apart, and building them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold import schema
from wayfold.functions.validation import NIL_ID, batch_reason, reading_reason, stop_reason
from wayfold.operators.ordered import Slicing, number_rows, resolve_slicing
from wayfold.operators.stops import event_id

CORRUPT = "_corrupt_record"
JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "allowNonNumericNumbers": "false",
}


RFC3339 = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
#: Refused items of a batch.
REJECTIONS = "array<struct<id:string,reason:string>>"
UUID = r"^(?i)(urn:uuid:)?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^[0-9a-f]{32}$"


def read_batches(
    spark: SparkSession, path: str, streaming: bool = False, uuid_ids: bool = False, **options
) -> DataFrame:
    """One row per batch, with `_corrupt_record` set where the line is not a valid batch: broken JSON, a
    wrong type, a time that is not RFC 3339 with a zone or, with `uuid_ids`, an id that is not a UUID.
    Fields the schema does not know are ignored."""
    reader = (spark.readStream if streaming else spark.read).schema(f"{schema.BATCH_TEXT}, {CORRUPT} string")
    return _typed(reader.options(**JSON_OPTIONS, **options).json(path), uuid_ids)


def parse_batches(lines: DataFrame, column: str = "value", uuid_ids: bool = False) -> DataFrame:
    """The same from a string column, keeping the other columns; for sources such as Kafka."""
    parsed = F.from_json(column, f"{schema.BATCH_TEXT}, {CORRUPT} string", JSON_OPTIONS)
    others = [c for c in lines.columns if c != column]
    return _typed(lines.select(*others, parsed.alias("b")).select(*others, "b.*"), uuid_ids)


def _typed(batches: DataFrame, uuid_ids: bool) -> DataFrame:
    """Times as timestamps; a batch with a malformed time or id becomes a corrupt record as a whole."""

    def fits(value, pattern):
        return value.isNull() | value.rlike(pattern)

    def moment(value):
        return F.when(value.rlike(RFC3339), value.try_cast("timestamp"))

    def given(column, field):
        return F.size(F.filter(column, lambda x: x[field].isNotNull()))

    def items_ok(column, times, name):
        """As many times could be read as are written; typed reads each of them once."""
        good = F.lit(True)
        for t in times:
            good = good & (given(column, t) == given(f"_{column}", t))
        if uuid_ids:
            good = good & F.forall(column, lambda x: fits(x[name], UUID))
        return F.coalesce(good, F.lit(True))

    def typed(column, times, kind):
        fields = [f.split(":")[0] for f in kind[7:-1].split(",")]
        return F.transform(
            column, lambda x: F.struct(*[(moment(x[f]) if f in times else x[f]).alias(f) for f in fields])
        )

    good = (
        (F.col("sent_at").isNull() == F.col("_sent_at").isNull())
        & items_ok("readings", ["recorded_at"], "reading_id")
        & items_ok("stop_events", ["arrived_at", "departed_at"], "event_id")
    )
    whole = F.to_json(F.struct("device_id", "sent_at", "readings", "stop_events"))
    corrupt = F.coalesce(F.col(CORRUPT), F.when(~good, whole))
    columns = {
        "device_id": F.col("device_id"),
        "sent_at": moment(F.col("sent_at")),
        "readings": typed("readings", ["recorded_at"], schema.READING),
        "stop_events": typed("stop_events", ["arrived_at", "departed_at"], schema.STOP_REPORT),
    }
    others = [c for c in batches.columns if c not in columns and c != CORRUPT]
    read = batches.withColumns({f"_{name}": value for name, value in columns.items() if name != "device_id"})
    marked = read.withColumn(CORRUPT, corrupt)
    bad = F.col(CORRUPT).isNotNull()
    kept = [F.when(~bad, F.col(f"_{name}")).alias(name) for name in columns if name != "device_id"]
    return marked.select(*others, "device_id", *kept, CORRUPT)


def judge_batches(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable batches, refused (device_id, reason)). A malformed batch is refused whole."""
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed JSON").otherwise(batch_reason())
    judged = batches.withColumn("reason", reason)
    usable = judged.filter("reason is null").drop("reason", CORRUPT)
    return usable, judged.filter("reason is not null").select("device_id", "reason")


def answer_batches(batches: DataFrame, keys: list[str]) -> DataFrame:
    """What each batch is answered: (*keys, reason, accepted, accepted_stops, rejected, rejected_stops).

    The last two name what is refused of a batch that is taken, as (id, reason) in the batch's order; reason says why a whole
    batch is refused, of which nothing is accepted or named. Each batch is judged within its row. They carry received_at.
    """

    def refused(column, rule, name):
        def judged(x):
            def of(field):
                return F.coalesce(x[field], F.lit(0.0)) if field in ("lat", "lon") else x[field]

            return F.struct(F.coalesce(x[name], F.lit(NIL_ID)).alias("id"), rule(F.col("received_at"), of).alias("reason"))

        found = F.filter(F.transform(column, judged), lambda r: r["reason"].isNotNull())
        return F.when(F.col("reason").isNull() & F.col(column).isNotNull(), found).otherwise(F.array().cast(REJECTIONS))

    def accepted(column, rejected):
        sent = F.when(F.col("reason").isNull() & F.col(column).isNotNull(), F.size(column)).otherwise(0)
        return (sent - F.size(rejected)).cast("bigint")

    whole = F.when(F.col(CORRUPT).isNotNull(), "malformed JSON").otherwise(batch_reason())
    named = batches.withColumn("reason", whole).withColumns({
        "rejected": refused("readings", reading_reason, "reading_id"),
        "rejected_stops": refused("stop_events", stop_reason, "event_id"),
    })
    return named.select(
        *keys, "reason",
        accepted("readings", "rejected").alias("accepted"), accepted("stop_events", "rejected_stops").alias("accepted_stops"),
        "rejected", "rejected_stops",
    )


def rejections(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, kind, id, reason) of everything that the answers name; with batch_id as the key, what resolve_acks asks for."""
    def of_kind(column, kind):
        return F.transform(column, lambda r: F.struct(F.lit(kind).alias("kind"), r["id"].alias("id"), r["reason"].alias("reason")))

    both = [of_kind("rejected", "reading"), of_kind("rejected_stops", "stop")]
    return answers.select(*keys, F.explode(F.concat(*both)).alias("r")).select(*keys, "r.*")


def vehicle_id_of(device_id: str = "device_id"):
    """The id register_vehicles gives a device."""
    return event_id("vehicle", F.col(device_id))


def with_vehicle_ids(rows: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Rows with the id the vehicle table has for their device; a device it lacks keeps the id it would get."""
    known = vehicles.groupBy(F.col("external_id").alias("device_id")).agg(F.min_by("id", "created_at").alias("_known"))
    found = rows.join(known, "device_id", "left").withColumn("vehicle_id", F.coalesce("_known", "vehicle_id"))
    return found.select(*rows.columns)


def batch_readings(batches: DataFrame) -> DataFrame:
    """Readings as position rows, with their place in the batch in batch_seq. The batches carry
    received_at. A missing coordinate reads as 0."""
    return _exploded(batches, "readings")


def batch_stops(batches: DataFrame) -> DataFrame:
    """Stop reports, with their place in the batch in batch_seq. A missing coordinate reads as 0."""
    return _exploded(batches, "stop_events")


def _exploded(batches, column):
    rows = batches.select("device_id", "received_at", F.posexplode(column).alias("batch_seq", "r"))
    rows = rows.select("device_id", "received_at", "batch_seq", "r.*")
    rows = rows.withColumn("vehicle_id", vehicle_id_of())
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("lat", "lon")})


def clock_offset(batches: DataFrame) -> DataFrame:
    """received_at - sent_at in milliseconds for every batch that says when it was sent."""
    offset = F.floor((F.unix_micros("received_at") - F.unix_micros("sent_at")) / 1000)
    return batches.filter("sent_at is not null").withColumn("offset_ms", offset.cast("bigint"))


def clock_offsets(batches: DataFrame) -> DataFrame:
    """Batches, mean and median clock offset per device."""
    return (
        clock_offset(batches)
        .groupBy("device_id")
        .agg(
            F.count(F.lit(1)).alias("batches"),
            F.avg("offset_ms").alias("mean_offset_ms"),
            F.percentile_approx("offset_ms", 0.5).alias("median_offset_ms"),
        )
    )


def ingest_response(accepted: DataFrame, accepted_stops: DataFrame) -> DataFrame:
    """Readings and stops accepted per device."""
    one, zero = F.lit(1), F.lit(0)
    readings = accepted.select("device_id", one.alias("r"), zero.alias("s"))
    both = readings.unionByName(accepted_stops.select("device_id", zero.alias("r"), one.alias("s")))
    return both.groupBy("device_id").agg(
        F.sum("r").alias("accepted"), F.sum("s").alias("accepted_stops")
    )


def to_batches(
    positions: DataFrame, stops: DataFrame, sent_at, size: int = 100, slicing: Slicing | None = None
) -> DataFrame:
    """Batches of at most `size` items per device in queue order: (device_id, batch_no, value), value
    being the JSON body. Absent optional values are left out, not written as null.

    positions need device_id and the reading columns, stops device_id and the report columns.
    """
    item = "struct<reading:{},stop:{}>".format(schema.READING, schema.STOP_REPORT)
    reading = [f.split(":")[0] for f in schema.READING[7:-1].split(",")]
    report = [f.split(":")[0] for f in schema.STOP_REPORT[7:-1].split(",")]
    none = F.lit(None)
    queued = positions.select(
        "device_id",
        F.col("recorded_at").alias("at"),
        F.concat(F.lit("r"), "reading_id").alias("tie"),
        F.struct(F.struct(*reading), none).cast(item).alias("item"),
    ).unionByName(
        stops.select(
            "device_id",
            F.coalesce("departed_at", "arrived_at").alias("at"),
            F.concat(F.lit("s"), "event_id").alias("tie"),
            F.struct(none, F.struct(*report)).cast(item).alias("item"),
        )
    )
    slicing = resolve_slicing(queued, ["device_id"], "at", slicing)
    numbered = number_rows(queued, ["device_id"], "at", ["at", "tie"], slicing, "n")

    def part(name):
        found = F.filter(F.transform("items", lambda x: x["item"][name]), lambda x: x.isNotNull())
        return found

    bodies = (
        numbered.groupBy("device_id", F.expr(f"n div {size}").alias("batch_no"))
        .agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("items"))
        .withColumn("body", F.struct(
            "device_id",
            sent_at.alias("sent_at"),
            part("reading").alias("readings"),
            part("stop").alias("stop_events"),
        ))
    )
    iso = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return bodies.select("device_id", "batch_no", F.to_json("body", iso).alias("value"))


def write_batches(batches: DataFrame, path: str) -> None:
    """JSON lines, one batch each."""
    batches.select("value").write.mode("append").text(path)

