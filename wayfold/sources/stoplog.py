"""The device's stop reports as a log with a folder per load, and a compacted state of the loads folded into it.

A row of the state keeps the places in the log of the report that gave it and of the one that closed it, so a load may be
folded late, or twice, and the state comes out the same. Reads lay the loads not folded yet over the state.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.session import materialise
from wayfold.sources.snapshots import Change, Snapshot, commit, latest, vacuum
from wayfold.sources.tables import children, exists, remove, utc_date

PLACE = ["vehicle_id", "arrived_at", "lat", "lon", "received_at"]
STOP_LOG = (
    "id string, vehicle_id string, arrived_at timestamp, departed_at timestamp, lat double, "
    "lon double, received_at timestamp, batch_seq bigint"
)
STATE = (
    "id string, vehicle_id string, arrived_at timestamp, departed_at timestamp, lat double, "
    "lon double, received_at timestamp, first_seq bigint, left_seq bigint"
)
COLUMNS = [c.split(" ")[0] for c in STATE.split(", ")]
#: The state's table, and the loads folded by the last commit, whose folders wait for the next one.
STOPS, FOLDED = "stops", "_folded"


def from_log(log: DataFrame) -> DataFrame:
    """A row of the state for each report of a log of collapsed batches."""
    left = F.when(F.col("departed_at").isNotNull(), F.col("batch_seq"))
    return log.withColumns({"first_seq": F.col("batch_seq"), "left_seq": left}).select(*COLUMNS)


def folded(rows: DataFrame) -> DataFrame:
    """One row per id: place and arrival of its first report, departure of the first one that has it."""
    first = F.min_by(F.struct(*PLACE, "first_seq"), F.struct("first_seq", "received_at")).alias("r")
    left = F.min(F.when(F.col("left_seq").isNotNull(), F.struct("left_seq", "departed_at"))).alias("l")
    return rows.groupBy("id").agg(first, left).select("id", "r.*", "l.*").select(*COLUMNS)


def over(state: DataFrame, tail: DataFrame) -> DataFrame:
    """The state with folded reports laid over it. Only rows with an id of the tail are regrouped; the others stream past its ids."""
    ids = tail.select("id")
    changed = folded(state.join(ids, "id", "left_semi").select(*COLUMNS).unionByName(tail))
    return state.join(ids, "id", "left_anti").select(*COLUMNS).unionByName(changed)


def _tail(spark: SparkSession, log: str, base: Snapshot, names: list[str]) -> tuple[list[str], DataFrame]:
    """Complete loads that the state does not hold, and their rows."""
    wanted = [n for n in names if n not in base.tables.get(FOLDED, {})]
    rows = spark.read.schema(STOP_LOG).parquet(*[f"{log}/{n}" for n in wanted]) if wanted else spark.createDataFrame([], STOP_LOG)
    return wanted, from_log(rows)


def _complete(spark: SparkSession, log: str) -> list[str]:
    return [n for n in children(spark, log) if n.startswith("load=") and exists(spark, f"{log}/{n}/_SUCCESS")]


def read_stops(spark: SparkSession, log: str, state: str) -> DataFrame:
    """The stops as all complete loads leave them; grouping and joins touch only the loads that are not folded yet."""
    # Folders first: what a commit folds meanwhile is then in both, which is no harm.
    names = _complete(spark, log)
    base = latest(spark, state)
    wanted, tail = _tail(spark, log, base, names)
    stored = base.read(spark, STOPS, STATE)
    return over(stored, folded(tail)) if wanted else stored


def compact(spark: SparkSession, log: str, state: str) -> int:
    """Fold the complete loads into the state and return how many there were.

    May run beside ingest and readers: a load that comes meanwhile stays in the tail. Only dates on which a stop changes are
    written anew. The folders of folded loads go with the next call, so that a reader may finish. Of two calls at once, one
    raises Conflict. A stop moves to another date if a late load turns out to hold its first report.
    """
    names = _complete(spark, log)
    base = latest(spark, state)
    old = base.tables.get(FOLDED, {})
    wanted, rows = _tail(spark, log, base, names)
    if wanted:
        tail = materialise(folded(rows))
        ids = tail.select("id")
        stored = base.read(spark, STOPS, STATE)
        known = materialise(stored.join(ids, "id", "left_semi").select(*COLUMNS))
        changed = materialise(folded(known.unionByName(tail)))
        touched = reduce(DataFrame.unionByName, [x.select(utc_date("arrived_at").alias("date")) for x in (known, changed)])
        dates = sorted(r["date"] for r in touched.distinct().collect())
        kept = base.read(spark, STOPS, STATE, dates).join(ids, "id", "left_anti").select(*COLUMNS)
        change = Change(kept.unionByName(changed), dates, "arrived_at", "departed_at")
        commit(spark, base, {STOPS: change}, {FOLDED: {n: ["", 0] for n in wanted}})
        vacuum(spark, state)
        for name in old:
            remove(spark, f"{log}/{name}")
    return len(wanted)
