"""Vehicle data derived by Spark from the `events` table, so that every query has real input.

Each user becomes a vehicle: the clock is compressed 300-fold, four samples dwell at a site and two
move on to the next. The same mapping is written in SQL for the oracle.
"""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.ordered import Slicing, choose_slicing, number_rows

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")


def _sized(name, sf_dir, df, keys, ts) -> Slicing:
    """Measured on every call: files under a folder may change."""
    return choose_slicing(df, keys, ts)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions table."""
    raw = events(spark, sf_dir).withColumn("ts", F.expr("cast(ts as timestamp)"))
    sized = _sized("events", sf_dir, raw, ["user_id"], "ts")
    n = number_rows(raw, ["user_id"], "ts", ["ts", "event_id"], sized)
    step = F.col("rn") % 6
    dwelling = step < 4
    us = F.lit(EPOCH_US) + F.expr(f"(unix_micros(ts) - {EPOCH_US}L) div 300")
    lat = (
        F.lit(49.0)
        + (F.col("user_id") % 100) * F.lit(0.001)
        + F.expr("rn div 6") * F.lit(0.01)
        + F.when(dwelling, (F.col("event_id") % 7) * F.lit(0.00002)).otherwise((step - 3) * F.lit(0.003))
    )
    speed = F.when(
        F.col("event_id") % 11 != 0,
        F.when(dwelling, (F.col("event_id") % 3) * F.lit(0.3)).otherwise(
            (F.col("event_id") % 9 + 8).cast("double")
        ),
    )
    accuracy = F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 60 + 3).cast("double"))
    late = F.when(F.expr("(rn div 50) % 10 = 9"), F.lit(21_600_000_000)).otherwise(F.lit(1_000_000))
    return n.select(
        F.col("event_id").cast("string").alias("reading_id"),
        F.col("user_id").cast("string").alias("vehicle_id"),
        F.timestamp_micros(us).alias("recorded_at"),
        F.timestamp_micros(us + late).alias("received_at"),
        lat.alias("lat"),
        (F.lit(-123.0) + (F.col("event_id") % 5) * F.lit(0.00003)).alias("lon"),
        speed.cast("float").alias("speed_mps"),
        F.when(F.col("event_id") % 17 != 0, (F.col("event_id") % 361).cast("float")).alias("heading_deg"),
        accuracy.cast("float").alias("accuracy_m"),
        F.when(F.col("event_id") % 19 != 0, F.lit(100) - F.expr("rn * 3 % 97"))
        .cast("smallint")
        .alias("battery_pct"),
        F.when(speed.isNull(), F.lit(None))
        .when(speed < 0.5, "still")
        .when(speed < 2.5, "walking")
        .otherwise("driving")
        .alias("motion_state"),
    )


def slicing(spark: SparkSession, sf_dir: str) -> Slicing:
    """Slicing of the derived positions, measured on every call."""
    raw = events(spark, sf_dir)
    compressed = F.timestamp_micros(
        F.lit(EPOCH_US) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH_US}L) div 300")
    )
    return _sized("positions", sf_dir, raw.select("user_id", compressed.alias("t")), ["user_id"], "t")


@functools.cache
def positions_sql() -> str:
    """The same mapping as a DuckDB CTE body named `pos`."""
    return f"""
r AS (SELECT user_id, event_id, epoch_us(ts) AS ts_us,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
m AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL
                     WHEN rn % 6 < 4 THEN (event_id % 3) * 0.3::double
                     ELSE (8 + (event_id % 9))::double END AS speed,
             {EPOCH_US} + (ts_us - {EPOCH_US}) // 300 AS us FROM r),
pos AS (SELECT CAST(event_id AS VARCHAR) AS reading_id, CAST(user_id AS VARCHAR) AS vehicle_id,
  event_id, user_id, rn, us,
  us + CASE WHEN (rn // 50) % 10 = 9 THEN 21600000000 ELSE 1000000 END AS received_us,
  49::double + (user_id % 100) * 0.001::double + (rn // 6) * 0.01::double
    + (CASE WHEN rn % 6 < 4 THEN (event_id % 7) * 0.00002::double
            ELSE (rn % 6 - 3) * 0.003::double END) AS lat,
  -123::double + (event_id % 5) * 0.00003::double AS lon,
  CAST(speed AS REAL) AS speed_mps,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 361 AS REAL) END AS heading_deg,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(3 + (event_id % 60) AS REAL) END AS accuracy_m,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE 100 - rn * 3 % 97 END AS battery_pct,
  CASE WHEN speed IS NULL THEN NULL WHEN speed < 0.5 THEN 'still' WHEN speed < 2.5 THEN 'walking'
       ELSE 'driving' END AS motion_state
  FROM m)"""
