"""Back-tests of the device's battery policy over recorded telemetry."""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.config import DrainConfig, SamplingConfig
from wayfold.functions.mapping import sampling_tier
from wayfold.operators.fold import US, fold
from wayfold.operators.ordered import Slicing, resolve_slicing, with_previous

KEYS = ["vehicle_id"]


@dataclass
class TierKernel:
    """State: {tier, since, pending: [tier, us] or None}; emits each change of tier."""

    dwell_us: int
    columns: tuple = ("wanted",)
    mark: str = "us"
    fields: dict = field(default_factory=lambda: {"us": "bigint", "tier": "string"})

    def run(self, state, cols):
        us, wanted = cols[US], cols["wanted"]
        tier, pending = (state["tier"], state["pending"]) if state else ("active", None)
        changes = []
        edges = np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1]]))
        for start, end in zip(edges, [*edges[1:], len(us)]):
            want = wanted[start]
            if want == tier:
                pending = None
            elif want == "active":
                tier, pending = want, None
                changes.append((int(us[start]), want))
            else:
                if pending is None or pending[0] != want:
                    pending = [want, int(us[start])]
                    start += 1
                # Adopted by the first evaluation a full dwell after it was first wanted.
                due = start + int(np.searchsorted(us[start:end], pending[1] + self.dwell_us))
                if due < end:
                    tier, pending = want, None
                    changes.append((int(us[due]), want))
        return {"tier": tier, "pending": pending}, {
            "us": [c[0] for c in changes],
            "tier": [c[1] for c in changes],
        }

    def finish(self, state):
        return {}

    def cut_off(self, state):
        return {}

    def cut(self, cols):
        # Whatever the tier was, it is active after a row that wants active.
        us = cols[US]
        hits = np.flatnonzero((cols["wanted"][:-1] == "active") & (us[1:] > us[:-1]))
        return int(hits[0]) + 1 if len(hits) else None

    def outline(self, cols):
        """The first run of one wish as far as a pending change may ask for it, and the state after the rest from each tier."""
        us, wanted = cols[US], cols["wanted"]
        change = np.flatnonzero(wanted[1:] != wanted[:-1])
        size = int(change[0]) + 1 if len(change) else len(us)
        head = min(size, int(np.searchsorted(us[:size], us[0] + self.dwell_us)) + 1)
        rest = {c: v[size:] for c, v in cols.items()}
        tiers = sorted({"active", *wanted.tolist()})
        after = {}
        if size < len(us):
            # A tier that the slice does not name behaves like any other one that it does not: only its name stays.
            for tier in [*tiers, "*"]:
                after[tier] = self.run({"tier": tier, "pending": None}, rest)[0]
        return {"wish": str(wanted[0]), "head": us[:head].tolist(), "last": int(us[size - 1]), "after": after}

    def enter(self, state, outline):
        first = {US: np.array(outline["head"]), "wanted": np.array([outline["wish"]] * len(outline["head"]), dtype=object)}
        # A pending change is older than the slice, so it falls due within the head if it does at all.
        now, changes = self.run(state, first)
        silent = not changes["us"]
        if outline["after"]:
            later = outline["after"].get(now["tier"]) or outline["after"]["*"]
            now = {**later, "tier": now["tier"] if later["tier"] == "*" else later["tier"]}
            silent = False
        return now, silent


HOUR_US = 3_600_000_000


def backtest_sampling(
    telemetry: DataFrame,
    charging: str | None = None,
    cfg: SamplingConfig = SamplingConfig(),
    slicing: Slicing | None = None,
) -> DataFrame:
    """Tier changes (vehicle_id, changed_at, tier) the policy would have made, starting from active.

    A slower tier is adopted once wanted without a break for min_tier_seconds; a return to active is
    immediate. `charging` names a boolean column; without it no device counts as charging.
    """
    plugged = F.col(charging) if charging else F.lit(False)
    wanted = telemetry.withColumn("wanted", sampling_tier("motion_state", "battery_pct", plugged, cfg))
    slicing = resolve_slicing(wanted, KEYS, "recorded_at", slicing)
    kernel = TierKernel(int(cfg.min_tier_seconds * 1_000_000))
    found = fold(wanted, KEYS, "recorded_at", ["reading_id"], kernel, slicing)
    return found.select("vehicle_id", F.timestamp_micros("us").alias("changed_at"), "tier")


def battery_drain(
    positions: DataFrame,
    cfg: DrainConfig = DrainConfig(),
    stationary_only: bool = False,
    slicing: Slicing | None = None,
) -> DataFrame:
    """Percent per hour lost while discharging, by fixes per hour: (band, vehicle_hours, hours,
    spent_pct, drain_pct_per_hour).

    Our reading of a published table that has no code: consecutive battery readings of a vehicle
    count when they are at most max_gap_seconds apart and the level did not rise; the band is the
    number of fixes in the vehicle-hour of the later one. `stationary_only` keeps vehicle-hours
    without a driving fix.
    """
    slicing = resolve_slicing(positions, KEYS, "recorded_at", slicing)
    us = F.unix_micros("recorded_at")
    hour = F.timestamp_micros(us - F.pmod(us, F.lit(HOUR_US))).alias("hour")
    hours = positions.groupBy("vehicle_id", hour).agg(
        F.count(F.lit(1)).alias("fixes"),
        F.count_if(F.col("motion_state") == "driving").alias("driving"),
    )
    known = positions.filter("battery_pct is not null").select(
        "vehicle_id", "recorded_at", "reading_id", "battery_pct"
    )
    order = ["recorded_at", "reading_id"]
    pairs = with_previous(known, KEYS, "recorded_at", order, ["recorded_at", "battery_pct"], slicing)
    seconds = (F.unix_micros("recorded_at") - F.unix_micros("prev.recorded_at")) / 1e6
    spent = F.col("prev.battery_pct") - F.col("battery_pct")
    usable = (
        pairs.select("vehicle_id", hour, seconds.alias("seconds"), spent.alias("spent"))
        .filter((F.col("spent") >= 0) & (F.col("seconds") <= cfg.max_gap_seconds))
        .groupBy("vehicle_id", "hour")
        .agg(F.sum("seconds").alias("seconds"), F.sum("spent").alias("spent"))
    )
    rated = usable.join(hours, ["vehicle_id", "hour"])
    if stationary_only:
        rated = rated.filter("driving = 0")
    starts = cfg.band_starts
    band = None
    for low, high in zip(starts, [*starts[1:], None]):
        label = f"{low}+" if high is None else f"{low}-{high - 1}"
        inside = (F.col("fixes") >= low) & (F.lit(True) if high is None else F.col("fixes") < high)
        band = F.when(inside, label) if band is None else band.when(inside, label)
    return (
        rated.withColumn("band", band)
        .filter("band is not null")
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("vehicle_hours"),
            (F.sum("seconds") / 3600).alias("hours"),
            F.sum("spent").alias("spent_pct"),
        )
        .withColumn("drain_pct_per_hour", F.when(F.col("hours") > 0, F.col("spent_pct") / F.col("hours")))
    )
