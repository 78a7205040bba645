"""Parquet layout of the tables.

Positions are partitioned by the date they were recorded, so windowed reads prune folders; inside a
file rows are ordered by vehicle and time, so row-group statistics prune further. Appends keep
arrival order, which leaves received_at clustered.
"""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold import schema
from wayfold.session import materialise

DATE = "recorded_date"


def utc_date(column: str):
    """The UTC date of a timestamp, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(column) / 86_400).cast("int"))


def _in_utc(moment: dt.datetime) -> dt.datetime:
    """An aware datetime in UTC; a naive one already is."""
    return moment.replace(tzinfo=dt.timezone.utc) if moment.tzinfo is None else moment.astimezone(dt.timezone.utc)


def append_positions(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Append positions. With `files`, rows are first ranged over that many tasks by date, vehicle and
    time: tasks are even however the rows fall, and a file holds few vehicles."""
    out = rows.withColumn(DATE, utc_date("recorded_at"))
    if files:
        out = out.repartitionByRange(files, DATE, "vehicle_id", "recorded_at")
    out = out.sortWithinPartitions(DATE, "vehicle_id", "recorded_at")
    out.write.mode("append").partitionBy(DATE).parquet(path)


def compact_positions(spark: SparkSession, path: str, first: dt.date, last: dt.date, rows_per_file: int = 4_000_000) -> None:
    """Write the folders of the dates first to last anew, with few files in order of vehicle and time.

    For dates that no running ingest appends to: rows added meanwhile would be lost.
    """
    stored = spark.read.schema(f"{schema.POSITIONS}, {DATE} date").parquet(path)
    rows = materialise(stored.filter(F.col(DATE).between(F.lit(first), F.lit(last))))
    order = [DATE, "vehicle_id", "recorded_at"]
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
    out = out.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
    out.partitionBy(DATE).parquet(path)


def read_positions(spark: SparkSession, path: str, frm=None, to=None) -> DataFrame:
    """Positions, optionally of [frm, to) given as datetimes, naive ones in UTC; the window prunes date folders."""
    rows = spark.read.schema(f"{schema.POSITIONS}, {DATE} date").parquet(path)
    if frm is not None:
        frm = _in_utc(frm)
        rows = rows.filter((F.col(DATE) >= F.lit(frm.date())) & (F.col("recorded_at") >= F.lit(frm)))
    if to is not None:
        to = _in_utc(to)
        rows = rows.filter((F.col(DATE) <= F.lit(to.date())) & (F.col("recorded_at") < F.lit(to)))
    return rows.drop(DATE)


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(jvm_path) and len(files.listStatus(jvm_path)) > 0


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it; one that does not exist is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A parquet table, empty when nothing has been written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(path)
