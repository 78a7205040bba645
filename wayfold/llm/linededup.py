"""Line deduplication against levelled sorted runs of line hashes.

A run is a table of line hashes with the document that holds each line first, bucketed and sorted by hash. A batch of
documents is joined with every run by merging equal buckets, loses the lines they know, and leaves its own new lines as a
further run. Runs of one level are merged into the next level once there are several, so few are ever searched.
Everything here is DataFrame operations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.store import shared_folder, written

#: Code points a line must have, stripped, to count.
LEAST_LENGTH = 10
#: Runs of a level that are merged into one of the next.
FAN_OUT = 2
#: Batches a whole table is added in.
BATCHES = 4

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, with A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, row, pos, h1, h2) of every line that counts; 128 bits of hash stand for the key."""
    keys = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc"), text_hash(F.col(text)).alias("row"), F.posexplode(lines_of(F.col(text))).alias("pos", "line")
    )
    keys = keys.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= LEAST_LENGTH)
    return keys.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineStore:
    """The runs of line hashes gathered so far."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_out: int = FAN_OUT):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select(*HASH, "owner").repartition(self.buckets, *HASH)
        dealt.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", shared_folder(self.spark, "run")).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def compact(self) -> None:
        """Merge full levels, from the newest on; no line is in two runs, so nothing has to be compared."""
        for level in range(len(self.levels)):
            names = self.levels[level]
            if len(names) >= self.fan_out:
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.union(self.spark.table(name))
                self._write(merged, level + 1)
                self.levels[level] = []
                for name in names:
                    self.spark.sql(f"DROP TABLE {name}")

    def add(self, lines: DataFrame) -> DataFrame:
        """(doc, row, pos) of the lines to drop from a batch, after which the batch's new lines are known.

        A line known from earlier batches is dropped from all documents; a new one stays in the smallest document that
        holds it.
        """
        self.compact()
        batch = lines.groupBy(*HASH).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        known = F.lit(None).cast("long")
        for number, run in enumerate(self.runs()):
            batch = batch.join(run.withColumnRenamed("owner", f"owner{number}"), HASH, "left")
            known = F.coalesce(known, F.col(f"owner{number}"))
        batch = written(batch.select(*HASH, "first", "last", known.alias("known")), "batch")
        self._write(batch.where("known IS NULL").withColumnRenamed("first", "owner"), 0)
        shared = batch.where("known IS NOT NULL OR first < last").select(*HASH, F.coalesce("known", "first").alias("owner"))
        return lines.join(written(shared, "shared"), HASH).where("doc != owner").select("doc", "row", "pos")

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def _dropped_flags(positions: Column) -> Column:
    """Sorted positions as an array of booleans up to the last one."""
    gaps = F.transform(positions, lambda x, i: x - F.coalesce(F.get(positions, i - 1), F.lit(-1)) - 1)
    return F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True)))))


def mark_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs with _kept, the lines that stay, and _n_lines, the number before.

    Batches are ranges of ascending ids, so the smallest id keeps a shared line. A null or empty text is one empty line.
    Documents without an id neither claim nor lose lines. Rows that share an id are one document: none of them loses a line
    because of the others.
    """
    spark = docs.sparkSession
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.select(F.col(doc_id).cast("double").alias("d")).approxQuantile("d", shares, 0.01) if shares else []
    number = sum([(F.col("doc") > cut).cast("int") for cut in cuts], F.lit(0))
    path = shared_folder(spark, "lines")
    hashed_lines(docs, doc_id, text).withColumn("batch", number).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc long, row long, pos int, h1 long, h2 long, batch int").parquet(path)
    store, drops = LineStore(spark), None
    for batch in range(len(cuts) + 1):
        found = written(store.add(lines.where(F.col("batch") == batch).drop("batch")), "drops")
        drops = found if drops is None else drops.union(found)
    store.close()
    flags = drops.groupBy("doc", "row").agg(_dropped_flags(F.sort_array(F.collect_list("pos"))).alias("_flags"))
    joined = docs.withColumns({"_doc": F.col(doc_id).cast("long"), "_row": text_hash(F.col(text))}).join(
        flags.withColumnsRenamed({"doc": "_doc", "row": "_row"}), ["_doc", "_row"], "left"
    )
    lines = lines_of(F.col(text))
    kept = F.when(F.col("_flags").isNull(), lines).otherwise(F.filter(lines, lambda x, i: ~F.coalesce(F.get("_flags", i), F.lit(False))))
    return joined.withColumns({"_kept": kept, "_n_lines": F.size(lines)}).drop("_doc", "_row", "_flags")


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs with the texts that remain; see mark_lines. A text of which nothing is dropped stays as it is, nulls too."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body = f"c{names.index(text)}"
    marked = mark_lines(inner, doc_id=f"c{names.index(doc_id)}", text=body, batches=batches)
    whole = F.size("_kept") == F.col("_n_lines")
    marked = marked.withColumn(body, F.when(whole, F.col(body)).otherwise(F.array_join("_kept", "\n")))
    return marked.select([F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
