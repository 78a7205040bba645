"""Which ids a table holds, without reading the table: runs of hashed buckets, each with a Bloom filter.

A load adds one run. To look ids up, each run's filters are asked for the ids of their buckets, and only the buckets that may
hold one are read. Ids need not be ordered in time. Runs of like size are merged, so their number grows with the logarithm
of the ids.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.session import materialise
from wayfold.sources.tables import read_table, remove

#: Ids for which a bucket is meant, bits of its filter for each, and hashes that set them.
BUCKET_IDS, BITS, HASHES = 1 << 19, 10, 7
#: So many runs of a size class are merged, and a class is so many times the one below.
FAN = 8
FILTER = "run string, buckets long, bucket long, ids long, filter binary"
IDS = "id string, part string"


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row for each hash function."""
    low, high = hashes.view(np.uint64) & np.uint64(0xFFFFFFFF), hashes.view(np.uint64) >> np.uint64(32) | np.uint64(1)
    return ((low + np.arange(HASHES, dtype=np.uint64)[:, None] * high) % np.uint64(bits)).astype(np.int64)


def _filter_of(hashes: np.ndarray) -> bytes:
    bits = np.zeros(-(-max(8, len(hashes) * BITS) // 8) * 8, bool)
    bits[_places(hashes, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def _may_hold(raw: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
    return bits[_places(hashes, len(bits))].all(axis=0)


class IdIndex:
    """The ids under a root folder. Adding a run anew replaces it; ids may be in several runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.ids, self.filters = spark, f"{root}/ids", f"{root}/filters"

    def runs(self) -> list[tuple[str, int, int]]:
        """(run, buckets, ids) of each run; few, since runs are merged."""
        rows = self._filters().groupBy("run", "buckets").agg(F.sum("ids").alias("n")).collect()
        return sorted((r["run"], r["buckets"], r["n"]) for r in rows)

    def _filters(self) -> DataFrame:
        return read_table(self.spark, self.filters, FILTER)

    def add(self, ids: DataFrame, run: str) -> None:
        """Store the strings of the one column of ids as a run."""
        ids = ids.toDF("id").where("id IS NOT NULL")
        n = ids.count()
        if not n:
            return
        buckets = 1 << max(0, (n - 1) // BUCKET_IDS).bit_length()
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets))
        placed = ids.withColumn("part", F.concat(F.lit(f"{run}."), bucket.cast("string")))
        # An id has one bucket, so the shuffle that brings buckets together also lets its copies meet.
        placed = placed.repartition("part").dropDuplicates(["part", "id"]).sortWithinPartitions("part", "id")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.ids)

        def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(run, buckets, key[0], len(rows), _filter_of(rows["h"].to_numpy()))], columns=[c.split(" ")[0] for c in FILTER.split(", ")])

        hashed = self.stored([f"{run}.{k}" for k in range(buckets)]).select(F.xxhash64("id").alias("h"))
        filters = hashed.groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).applyInPandas(build, FILTER)
        filters.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(self.filters)

    def stored(self, parts: list[str]) -> DataFrame:
        """The ids of some buckets; other folders are not read."""
        return read_table(self.spark, self.ids, IDS).where(F.col("part").isin(parts))

    def known(self, ids: DataFrame) -> DataFrame:
        """Those of ids (one column) that a run holds, as a column id."""
        asked = ids.toDF("id").where("id IS NOT NULL").distinct()
        runs = self.runs()
        if not runs:
            return asked.where(F.lit(False))
        layout = F.array(*[F.struct(F.lit(run).alias("run"), F.lit(buckets).cast("long").alias("buckets")) for run, buckets, _ in runs])
        probes = asked.select("id", F.xxhash64("id").alias("h"), F.explode(layout).alias("r")).select("id", "h", "r.run", F.pmod("h", "r.buckets").alias("bucket"))

        def test(key: tuple, asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if filters.empty or asked.empty:
                return pd.DataFrame({"id": [], "part": []}, dtype=str)
            hit = asked[_may_hold(filters["filter"].iloc[0], asked["h"].to_numpy())]
            return pd.DataFrame({"id": hit["id"], "part": f"{key[0]}.{key[1]}"})

        both = probes.groupBy("run", "bucket").cogroup(self._filters().groupBy("run", "bucket"))
        likely = materialise(both.applyInPandas(test, "id string, part string"))
        # At most as many as there are buckets.
        parts = [r["part"] for r in likely.select("part").distinct().collect()]
        if not parts:
            return asked.where(F.lit(False))
        return self.stored(parts).join(likely, ["part", "id"], "left_semi").select("id").distinct()

    def compact(self) -> None:
        """Merge the runs of each size class that has FAN of them. A run goes once its ids are in another one."""
        classes: dict[int, list[tuple[str, int, int]]] = {}
        for run in self.runs():
            classes.setdefault(max(run[2], 1).bit_length() // FAN.bit_length(), []).append(run)
        for _, runs in sorted(classes.items()):
            if len(runs) >= FAN:
                parts = [f"{run}.{k}" for run, buckets, _ in runs for k in range(buckets)]
                self.add(self.stored(parts).select("id"), f"merged-{uuid.uuid4().hex}")
                for run, _, _ in runs:
                    remove(self.spark, f"{self.filters}/run={run}")
                for part in parts:
                    remove(self.spark, f"{self.ids}/part={part}")

