"""Per-vehicle ordered work that holds when one vehicle owns a large share of the rows.

A window over a whole vehicle puts that vehicle in one task. Here a busy vehicle's timeline is cut into
time slices; windows run inside (vehicle, slice), and what a slice needs from earlier ones is
carried over by a per-slice summary (one row per non-empty slice). `choose_slicing` measures the
data: only vehicles of more than `target_rows` rows are cut, each by its own rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.session import materialise

SLICE = "_slice"
TARGET_ROWS = 500_000
DAY_US, SECOND_US = 86_400_000_000, 1_000_000


@dataclass(frozen=True)
class Slicing:
    """Width of a time slice in microseconds; None keeps each vehicle whole."""

    width_us: int | None = None

    @property
    def whole(self) -> bool:
        return self.width_us is None

    def column(self, ts: str) -> Column:
        if self.whole:
            return F.lit(0).cast("bigint")
        return F.expr(f"unix_micros(cast({ts} as timestamp)) div {self.width_us}L")

    def attach(self, df: DataFrame, keys: list[str], ts: str) -> DataFrame:
        """df with the slice of each row in SLICE; slices of a key are numbered in time order."""
        return df.withColumn(SLICE, self.column(ts))


@dataclass(frozen=True)
class KeySlicing:
    """Busy keys cut by their own rows, all others whole, in one plan. cuts: (keys, _day, _cuts), a row for each day of a
    busy key with the ascending first microseconds of its slices. Rows that it is attached to lie on such days."""

    cuts: DataFrame

    @property
    def whole(self) -> bool:
        return False

    def attach(self, df: DataFrame, keys: list[str], ts: str) -> DataFrame:
        moment = F.expr(f"unix_micros(cast({ts} as timestamp))")
        dated = df.withColumn("_day", F.expr(f"unix_micros(cast({ts} as timestamp)) div {DAY_US}L"))
        first = F.array_max(F.filter("_cuts", lambda cut: cut <= moment))
        return dated.join(self.cuts, [*keys, "_day"], "left").withColumn(SLICE, F.coalesce(first, F.lit(0))).select(*df.columns, SLICE)


WHOLE = Slicing(None)


def choose_slicing(df: DataFrame, keys: list[str], ts: str, target_rows: int = TARGET_ROWS) -> Slicing | KeySlicing:
    """Keys of more than target_rows rows cut into slices of about so many, the others whole.

    One scan counts the rows of each key, and if one has too many, another the days of such keys. Only in days that hold
    too many rows themselves are seconds counted, and cut where their running sum passes the target; a slice has at most
    target_rows rows and those of its last second.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    if (sizes.agg(F.max("_all")).first()[0] or 0) <= target_rows:
        return WHOLE
    day, second = (F.expr(f"unix_micros(cast({ts} as timestamp)) div {w}L") for w in (DAY_US, SECOND_US))
    busy = sizes.filter(F.col("_all") > target_rows).select(*keys)
    days = df.groupBy(*keys, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n")).join(busy, keys, "left_semi")
    days = materialise(days)
    dense = days.filter(F.col("_n") > target_rows).select(*keys, "_day")
    seconds = df.select(*keys, day.alias("_day"), second.alias("_second")).join(dense, [*keys, "_day"], "left_semi")
    seconds = seconds.groupBy(*keys, "_day", "_second").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys, "_day").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    placed = seconds.withColumn("_piece", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / target_rows))
    inner = placed.groupBy(*keys, "_day", "_piece").agg((F.min("_second") * SECOND_US).alias("_cut"))
    cuts = days.select(*keys, "_day", (F.col("_day") * DAY_US).alias("_cut")).unionByName(inner.select(*keys, "_day", "_cut"))
    return KeySlicing(materialise(cuts.groupBy(*keys, "_day").agg(F.array_sort(F.collect_set("_cut")).alias("_cuts"))))


def resolve_slicing(df: DataFrame, keys: list[str], ts: str, slicing: Slicing | KeySlicing | None) -> Slicing | KeySlicing:
    return choose_slicing(df, keys, ts) if slicing is None else slicing


def carry_in(sliced: DataFrame, keys: list[str], summary: list[Column], carried: list[Column]) -> DataFrame:
    """Attach to every row values computed over the earlier slices of its key.

    `summary` are aggregates per (keys, slice); `carried` are window expressions over the summary
    rows, built with `earlier_slices(keys)`. Both sides are hash-partitioned by (keys, slice).
    """
    per_slice = sliced.groupBy(*keys, SLICE).agg(*summary)
    return sliced.join(per_slice.select(*keys, SLICE, *carried), [*keys, SLICE], "left")


def earlier_slices(keys: list[str]):
    return (
        Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )


def inside_slice(keys: list[str], order: list):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def number_rows(df, keys, ts, order, slicing: Slicing, name="rn") -> DataFrame:
    """0-based position of each row in the order of its key."""
    if slicing.whole:
        # Without the slice as a key, what is grouped by keys and the number afterwards needs no other shuffle.
        whole = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.withColumn(name, whole.cast("bigint"))
    sliced = slicing.attach(df, keys, ts)
    local = F.row_number().over(inside_slice(keys, order)) - 1
    offset = F.sum("_n").over(earlier_slices(keys)).alias("_offset")
    out = carry_in(sliced, keys, [F.count(F.lit(1)).alias("_n")], [offset])
    numbered = (local + F.coalesce("_offset", F.lit(0))).cast("bigint")
    return out.withColumn(name, numbered).drop(SLICE, "_offset")


def with_previous(df, keys, ts, order, columns, slicing: Slicing, name="prev") -> DataFrame:
    """Add struct `name` holding `columns` of the previous row of the key, NULL on the first row."""
    sliced = slicing.attach(df, keys, ts)
    local = F.lag(F.struct(*columns)).over(inside_slice(keys, order))
    if slicing.whole:
        return sliced.withColumn(name, local).drop(SLICE)
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    before = F.last("_last").over(earlier_slices(keys)).alias("_before")
    out = carry_in(sliced, keys, [last], [before])
    return out.withColumn(name, F.coalesce(local, F.col("_before"))).drop(SLICE, "_before")


def fill_forward(df, keys, ts, order, value: str, slicing: Slicing, name: str) -> DataFrame:
    """Add `name`: the latest non-null `value` at or before the row in the order of its key."""
    sliced = slicing.attach(df, keys, ts)
    upto = inside_slice(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.last(value, ignorenulls=True).over(upto)
    if slicing.whole:
        return sliced.withColumn(name, local).drop(SLICE)
    present = F.when(F.col(value).isNotNull(), F.struct(*order))
    last = F.max_by(value, present).alias("_last")
    before = F.last("_last", ignorenulls=True).over(earlier_slices(keys)).alias("_before")
    out = carry_in(sliced, keys, [last], [before])
    return out.withColumn(name, F.coalesce(local, F.col("_before"))).drop(SLICE, "_before")
