"""Windowed reads over positions, trips, stops and vehicles."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.config import LOCAL_HISTORY_LIMIT, MAX_ACTIVE_DAYS, MAX_POSITIONS_PER_PAGE
from wayfold.functions.predicates import in_window, overlaps, source_is
from wayfold.operators.ordered import DAY_US

FINAL_SALTS = 8


def first_n(df: DataFrame, keys: list[str], order: list, n: int, spread: str, name="rn") -> DataFrame:
    """The first n rows of every key, numbered from 1 in `name`.

    Ranks within (key, hash of `spread`) for as many hashes as there are shuffle partitions, then among
    the survivors for a few, then among theirs. So one key's rows are spread over all tasks, and the last
    ranking sees at most FINAL_SALTS * n of them.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(spread), F.lit(FINAL_SALTS * max(1, partitions // FINAL_SALTS)))
    rows = df.select("*", salt.alias("_salt"))
    rounds = [["_salt"], [F.pmod("_salt", F.lit(FINAL_SALTS))]] if partitions >= 2 * FINAL_SALTS else [["_salt"]]
    for extra in [*rounds, []]:
        rank = F.row_number().over(Window.partitionBy(*keys, *extra).orderBy(*order))
        rows = rows.withColumn(name, rank).filter(F.col(name) <= n)
    return rows.drop("_salt")


def samples(positions: DataFrame, frm, to) -> DataFrame:
    """The narrow scan derivation reads; window and columns reach the file source."""
    inside = positions.filter(in_window("recorded_at", frm, to))
    return inside.select("vehicle_id", "recorded_at", "reading_id", "lat", "lon", "speed_mps")


def active_vehicles(positions: DataFrame, frm, to) -> DataFrame:
    return positions.filter(in_window("recorded_at", frm, to)).select("vehicle_id").distinct()


def positions_page(positions: DataFrame, frm, to, limit: int = 0) -> DataFrame:
    """The oldest `limit` positions of every vehicle in [frm, to), with `seq` from 1 and `truncated`,
    whether the window held more."""
    if limit <= 0 or limit > MAX_POSITIONS_PER_PAGE:
        limit = MAX_POSITIONS_PER_PAGE
    inside = positions.filter(in_window("recorded_at", frm, to))
    rows = first_n(inside, ["vehicle_id"], ["recorded_at", "reading_id"], limit + 1, "reading_id", "seq")
    whole = Window.partitionBy("vehicle_id")
    return rows.withColumn("truncated", F.max("seq").over(whole) > limit).filter(F.col("seq") <= limit)


def local_since(positions: DataFrame, frm, limit: int = LOCAL_HISTORY_LIMIT) -> DataFrame:
    """The oldest `limit` positions of every device recorded at or after frm."""
    recent = positions.filter(F.col("recorded_at") >= frm)
    return first_n(recent, ["vehicle_id"], ["recorded_at", "reading_id"], limit, "reading_id", "seq")


def list_trips(trips: DataFrame, frm, to, now) -> DataFrame:
    inside = trips.filter(overlaps("started_at", "ended_at", frm, to, now))
    return inside.orderBy("vehicle_id", F.desc("started_at"))


def list_stops(stops: DataFrame, frm, to, now, source: str = "") -> DataFrame:
    inside = stops.filter(overlaps("arrived_at", "departed_at", frm, to, now) & source_is(source))
    return inside.orderBy("vehicle_id", "arrived_at")


def last_reports(positions: DataFrame) -> DataFrame:
    return positions.groupBy("vehicle_id").agg(F.max("recorded_at").alias("last_reported_at"))


def _with_last_report(vehicles, positions):
    latest = last_reports(positions).withColumnRenamed("vehicle_id", "id")
    return vehicles.join(latest, "id", "left")


def list_vehicles(vehicles: DataFrame, positions: DataFrame) -> DataFrame:
    """Vehicles with their last report, most recent first, silent ones last."""
    order = [F.desc_nulls_last("last_reported_at"), "external_id"]
    return _with_last_report(vehicles, positions).orderBy(*order)


def most_recent_vehicle(vehicles: DataFrame, positions: DataFrame) -> DataFrame:
    """The vehicle that reported last; a silent one only if all are."""
    return list_vehicles(vehicles, positions).limit(1)


def latest_position(positions: DataFrame) -> DataFrame:
    """The newest position of every vehicle, by aggregation, so a busy vehicle is combined map-side."""
    newest = F.max_by(F.struct(*positions.columns), F.struct("recorded_at", "reading_id"))
    return positions.groupBy("vehicle_id").agg(newest.alias("p")).select("p.*")


def last_fix(positions: DataFrame) -> DataFrame:
    """Fix count and last fix of every device, coordinates to 5 decimals, whole metres of accuracy."""
    fix = F.struct("lat", "lon", "accuracy_m", "recorded_at")
    newest = F.max_by(fix, F.struct("recorded_at", "reading_id")).alias("p")
    return (
        positions.groupBy("vehicle_id")
        .agg(F.count(F.lit(1)).alias("fixes"), newest)
        .select(
            "vehicle_id",
            "fixes",
            F.round("p.lat", 5).alias("lat"),
            F.round("p.lon", 5).alias("lon"),
            F.floor(F.col("p.accuracy_m") + F.lit(0.5)).alias("accuracy_m"),
            F.col("p.recorded_at").alias("recorded_at"),
        )
    )


def count_positions(positions: DataFrame) -> DataFrame:
    return positions.agg(F.count(F.lit(1)).alias("positions"))


def active_days(positions: DataFrame, tz: str = "UTC", limit: int = 0) -> DataFrame:
    """The newest `limit` local calendar days on which each vehicle reported, in time zone tz."""
    if limit <= 0 or limit > MAX_ACTIVE_DAYS:
        limit = MAX_ACTIVE_DAYS
    local = F.unix_micros(F.from_utc_timestamp("recorded_at", tz or "UTC"))
    day = F.timestamp_micros(local - F.pmod(local, F.lit(DAY_US)))  # date_trunc would follow the session's time zone
    days = positions.groupBy("vehicle_id", day.alias("day")).agg(
        F.count(F.lit(1)).alias("fixes"),
        F.min("recorded_at").alias("first"),
        F.max("recorded_at").alias("last"),
    )
    newest = Window.partitionBy("vehicle_id").orderBy(F.desc("day"))
    return days.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= limit).drop("_rank")


def trip_distance(trips: DataFrame, keys: tuple = ("vehicle_id",)) -> DataFrame:
    """Trips and metres per key; add a `day` column to trips to report per day."""
    return trips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trips"), F.sum("distance_m").alias("distance_m")
    )
