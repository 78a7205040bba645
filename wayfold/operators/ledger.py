"""Delivery ledger: queued items, what the server answered, and what becomes of each item."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.config import DEAD_ITEMS_LIMIT, MAX_ATTEMPTS, MAX_QUEUE_SIZE
from wayfold.functions.predicates import at
from wayfold.operators.load import first_writes
from wayfold.operators.reads import first_n


def enqueue(ledger: DataFrame, items: DataFrame) -> DataFrame:
    """Add items whose id is not queued yet; a queued one keeps its attempts."""
    fresh = first_writes(items, "id", ["created_at"]).join(ledger.select("id"), "id", "left_anti")
    return ledger.unionByName(fresh.select(*ledger.columns))


def oldest_n(ledger: DataFrame, n: int, keys: tuple = ("device_id",)) -> DataFrame:
    """The n oldest items of every queue, numbered from 1 in `position`."""
    return first_n(ledger, list(keys), ["created_at", "id"], n, "id", "position")


def trim_to_cap(
    ledger: DataFrame, cap: int = MAX_QUEUE_SIZE, keys: tuple = ("device_id",)
) -> tuple[DataFrame, DataFrame]:
    """(the newest cap items of every queue, how many each queue dropped)."""
    keys = list(keys)
    newest = [F.desc("created_at"), F.desc("id")]
    kept = first_n(ledger, keys, newest, cap, "id", "_rank").drop("_rank")
    sizes = ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("queued"))
    dropped = sizes.select(*keys, F.greatest(F.col("queued") - cap, F.lit(0)).alias("dropped"))
    return kept, dropped


def dead_items(dead: DataFrame, limit: int = DEAD_ITEMS_LIMIT, keys: tuple = ("device_id",)) -> DataFrame:
    """The items quarantined last in every queue."""
    order = [F.desc("quarantined_at"), "id"]
    return first_n(dead, list(keys), order, limit, "id", "position")


def with_wire_id(ledger: DataFrame) -> DataFrame:
    """Add wire_id, the id the server knows an item by: its reading's or its stop's, else its own.
    The payload is parsed once per row."""
    ids = F.json_tuple("payload", "reading_id", "event_id").alias("_reading", "_event")
    found = ledger.select("*", ids).withColumn("wire_id", F.coalesce("_reading", "_event", "id"))
    return found.drop("_reading", "_event")


def resolve_acks(ledger: DataFrame, rejections: DataFrame) -> DataFrame:
    """(batch_id, id, verdict) of items sent in accepted batches. `rejections` names wire ids per
    batch; the two reports of one stop share a wire id, and an item not named was accepted."""
    refused = rejections.select("batch_id", F.col("id").alias("wire_id")).distinct()
    refused = refused.withColumn("_refused", F.lit(True))
    sent = with_wire_id(ledger.select("batch_id", "id", "payload"))
    verdict = F.when(F.col("_refused"), "rejected").otherwise("accepted").alias("verdict")
    return sent.join(refused, ["batch_id", "wire_id"], "left").select("batch_id", "id", verdict)


def plan_outcomes(
    ledger: DataFrame, outcomes: DataFrame, verdicts: DataFrame, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """The ledger rows that were sent, each with `action`, `verdict` and `error`.

    outcomes: (batch_id, outcome, reason) with outcome accepted, shed, rejected or unavailable.
    verdicts: (batch_id, id, verdict). Items an accepted batch left unnamed fail; shedding costs no
    attempt; a refused request quarantines items on their last attempt; an unreachable server never
    quarantines.
    """
    sent = ledger.join(outcomes, "batch_id").join(verdicts, ["batch_id", "id"], "left")
    missing = (
        sent.filter("outcome = 'accepted' and verdict is null")
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("_missing"))
    )
    outcome = F.col("outcome")
    last_try = F.col("attempts") + 1 >= max_attempts
    action = (
        F.when(outcome == "accepted", F.when(F.col("verdict").isNotNull(), "remove").otherwise("fail"))
        .when(outcome == "shed", "keep")
        .when((outcome == "rejected") & last_try, "quarantine")
        .otherwise("fail")
    )
    error = (
        F.when(
            (outcome == "accepted") & (F.col("_missing") > 0),
            F.format_string("%d item(s) missing from the server response", "_missing"),
        )
        .when(outcome == "shed", "server shed load")
        .when(outcome.isin("rejected", "unavailable"), F.col("reason"))
    )
    kept = F.when(outcome == "accepted", F.col("verdict")).alias("verdict")
    return sent.join(missing, "batch_id", "left").select(
        *ledger.columns, "outcome", kept, action.alias("action"), error.alias("error")
    )


def apply_actions(ledger: DataFrame, actions: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(live items, newly dead items). Removed and quarantined items leave; failed ones gain an attempt."""
    planned = actions.select("id", "action", "error")
    joined = ledger.join(planned, "id", "left")
    action = F.coalesce("action", F.lit("keep"))
    failed = action == "fail"
    live = joined.filter(~action.isin("remove", "quarantine")).withColumns(
        {
            "attempts": F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "last_error": F.when(failed, F.col("error")).otherwise(F.col("last_error")),
        }
    )
    dead = joined.filter(action == "quarantine").select(
        *[c for c in ledger.columns if c != "last_error"],
        F.col("error").alias("reason"),
        at(now).alias("quarantined_at"),
    )
    return live.select(*ledger.columns), dead


def drain_counts(ledger: DataFrame, actions: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """Per device: items sent, accepted, rejected, quarantined, dropped by the cap, and remaining."""
    queued = ledger.groupBy("device_id").agg(F.count(F.lit(1)).alias("queued"))
    done = actions.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(F.col("verdict") == "accepted").alias("accepted"),
        F.count_if(F.col("verdict") == "rejected").alias("rejected"),
        F.count_if(F.col("action") == "quarantine").alias("quarantined"),
        F.count_if(F.col("action").isin("remove", "quarantine")).alias("_left"),
    )
    out = queued.join(done, "device_id", "left")
    lost = F.lit(0).cast("bigint")
    if dropped is not None:
        out, lost = out.join(dropped, "device_id", "left"), F.coalesce("dropped", F.lit(0))

    def or_zero(c):
        return F.coalesce(c, F.lit(0)).alias(c)

    return out.select(
        "device_id",
        or_zero("sent"),
        or_zero("accepted"),
        or_zero("rejected"),
        or_zero("quarantined"),
        lost.alias("dropped"),
        (F.col("queued") - F.coalesce("_left", F.lit(0))).alias("remaining"),
    )
