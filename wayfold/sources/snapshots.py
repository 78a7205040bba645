"""Several tables that change together: files are written beside the old ones, then one small manifest names them all.

Rows of a table lie in folders by date and version. The manifest maps each table's dates to the version that holds them and to
the latest end of a row there, so readers open only the dates whose rows can touch their window. A manifest appears by one
rename; a reader has the tables as they were before it or as they are after it, never some of each.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources.tables import children, remove, utc_date

MANIFESTS = "_manifests"
#: An end after every other: rows that are still open.
OPEN_US = 2**62


class Conflict(RuntimeError):
    """Another run has committed meanwhile; derive again from what is there now."""


@dataclass(frozen=True)
class Change:
    """What a commit does to a table: on each of these dates the rows are replaced by `rows`, which may lie on no others.

    start dates a row, end says until when it lasts (NULL: still open)."""

    rows: DataFrame
    dates: list[dt.date]
    start: str
    end: str


@dataclass(frozen=True)
class Snapshot:
    """Tables under a root as one manifest has them."""

    root: str
    number: int
    tables: dict[str, dict[str, list]]  # table: {date: [version, latest end in microseconds]}

    def dates(self, table: str, frm_us: int, to_us: int) -> list[dt.date]:
        """Dates on which rows may lie that touch [frm, to)."""
        found = ((dt.date.fromisoformat(d), end) for d, (_, end) in self.tables.get(table, {}).items())
        return sorted(d for d, end in found if _first_us(d) < to_us and end >= frm_us)

    def read(self, spark: SparkSession, table: str, ddl: str, dates: list[dt.date] | None = None) -> DataFrame:
        """The rows of a table, of some dates only if these are given."""
        held = self.tables.get(table, {})
        wanted = [d for d in held if dates is None or dt.date.fromisoformat(d) in set(dates)]
        paths = [f"{self.root}/{table}/version={held[d][0]}/date={d}" for d in sorted(wanted)]
        return spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)


def _first_us(date: dt.date) -> int:
    return (date - dt.date(1970, 1, 1)).days * 86_400_000_000


def _manifests(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in children(spark, f"{root}/{MANIFESTS}") if n.endswith(".json") and n[0] != ".")


def latest(spark: SparkSession, root: str) -> Snapshot:
    """The last committed state; no tables if nothing has been committed."""
    numbers = _manifests(spark, root)
    if not numbers:
        return Snapshot(root, 0, {})
    raw = spark.read.text(f"{root}/{MANIFESTS}/{numbers[-1]}.json", wholetext=True).first()[0]
    return Snapshot(root, numbers[-1], json.loads(raw))


def commit(spark: SparkSession, base: Snapshot, changes: dict[str, Change], notes: dict[str, dict] | None = None) -> Snapshot:
    """Write the changes of all tables, then make them visible at once. Raises Conflict if base is no longer the latest.

    notes are entries of the manifest that stand for no table; each replaces the entry of its name."""
    version, tables = uuid.uuid4().hex, {name: dict(held) for name, held in base.tables.items()} | (notes or {})
    for name, change in changes.items():
        path = f"{base.root}/{name}/version={version}"
        last = F.max(F.coalesce(F.unix_micros(change.end), F.lit(OPEN_US))).alias("last")
        # A date with many rows is split over several tasks, and few rows make few files.
        dated = change.rows.withColumn("date", utc_date(change.start)).hint("rebalance", F.col("date"))
        dated.write.partitionBy("date").parquet(path)
        held = tables.setdefault(name, {})
        for date in change.dates:
            held.pop(date.isoformat(), None)
        if children(spark, path) != ["_SUCCESS"]:
            written = spark.read.option("basePath", path).parquet(path)
            # A row for each date that the change touches.
            held.update({str(r["date"]): [version, r["last"]] for r in written.groupBy("date").agg(last).collect()})
    _publish(spark, base, json.dumps(tables))
    return Snapshot(base.root, base.number + 1, tables)


def _publish(spark: SparkSession, base: Snapshot, text: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = f"{base.root}/{MANIFESTS}"
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    draft, final = path(f"{folder}/.{uuid.uuid4().hex}"), path(f"{folder}/{base.number + 1}.json")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise Conflict(f"manifest {base.number + 1} of {base.root} exists")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove manifests but the last ones, and versions that none of these names. Not beside a running commit."""
    numbers = _manifests(spark, root)
    for number in numbers[:-keep]:
        remove(spark, f"{root}/{MANIFESTS}/{number}.json")
    states = [json.loads(spark.read.text(f"{root}/{MANIFESTS}/{n}.json", wholetext=True).first()[0]) for n in numbers[-keep:]]
    for table in {t for s in states for t in s}:
        used = {f"version={entry[0]}" for s in states for entry in s.get(table, {}).values()}
        for name in children(spark, f"{root}/{table}"):
            if name.startswith("version=") and name not in used:
                remove(spark, f"{root}/{table}/{name}")
