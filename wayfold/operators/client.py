"""The device's own stop detector, as a batch pass over fixes and as the step a stream repeats."""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.config import ClientConfig
from wayfold.functions.predicates import is_stationary, usable_fix
from wayfold.operators.fold import US, fold
from wayfold.operators.ordered import Slicing, resolve_slicing
from wayfold.operators.reach import Blocks, Near, ends_of, first_piece_beyond, pieces_of
from wayfold.operators.stops import KEYS, event_id, first_jump, first_outside


def advance(state, us, lat, lon, still, radius, dwell_us):
    """Feed time-ordered usable fixes to the detector.

    State is None (no candidate) or {anchor: [lat, lon, us], last: us, open: bool}. Returns the new
    state and emissions (kind, lat, lon, arrived_us, departed_us). Fixes older than the last one
    seen inside the radius are dropped.
    """
    emitted = []
    n, at = len(us), 0
    if state:
        anchor, last, is_open = state["anchor"], state["last"], state["open"]
        at = int(np.searchsorted(us, last, side="left"))
    else:
        anchor, last, is_open = None, None, False
    stationary = np.flatnonzero(still)
    while True:
        if anchor is None:
            k = np.searchsorted(stationary, at)
            if k == len(stationary):
                return None, emitted
            at = int(stationary[k])
            anchor, is_open = [float(lat[at]), float(lon[at]), int(us[at])], False
            last = anchor[2]
            at += 1
        out = first_outside(lat, lon, at, anchor[0], anchor[1], radius)
        end = n if out is None else out
        if end > at:
            last = int(us[end - 1])
            if not is_open and last - anchor[2] >= dwell_us:
                is_open = True
                emitted.append(("arrived", *anchor, None))
        if out is None:
            return {"anchor": anchor, "last": last, "open": is_open}, emitted
        if is_open:
            emitted.append(("departed", *anchor, last))
        anchor, at = None, (out if still[out] else out + 1)


@dataclass
class ClientKernel:
    radius: float
    dwell_us: int
    columns: tuple = ("lat", "lon", "still")
    mark: str = "arrived_us"
    fields: dict = field(
        default_factory=lambda: {
            "kind": "string",
            "lat": "double",
            "lon": "double",
            "arrived_us": "bigint",
            "departed_us": "bigint",
        }
    )

    def run(self, state, cols):
        state, emitted = advance(
            state, cols[US], cols["lat"], cols["lon"], cols["still"].astype(bool), self.radius, self.dwell_us
        )
        return state, self._rows(emitted)

    def _rows(self, emitted):
        return {name: [e[i] for e in emitted] for i, name in enumerate(self.fields)}

    def finish(self, state):
        return {}

    def cut_off(self, state):
        return self._rows([("departed", *state["anchor"], state["last"])]) if state and state["open"] else {}

    def cut(self, cols):
        return first_jump(cols[US], cols["lat"], cols["lon"], 2 * self.radius * (1 + 1e-9))

    def outline(self, cols):
        """Where the detector ends if it looks for a candidate from a row of the slice on, by the rows' outermost points."""
        us, lat, lon, still = cols[US], cols["lat"], cols["lon"], cols["still"].astype(bool)
        n, rests = len(us), np.flatnonzero(still)
        leaves = Blocks(lat, lon).first_beyond(lat[rests], lon[rests], rests + 1, Near(self.radius))
        successor = np.minimum(np.arange(n + 1) + 1, n)
        successor[rests] = np.where(leaves < n, leaves, rests)
        ends, states = ends_of(successor), {}
        for end in np.unique(ends).tolist():
            anchor = [float(lat[end]), float(lon[end]), int(us[end])] if end < n else None
            states[end] = anchor and {"anchor": anchor, "last": int(us[-1]), "open": bool(us[-1] - us[end] >= self.dwell_us)}
        return {"pieces": pieces_of(ends[:n], lat, lon, self.radius), "states": states, "last": int(us[-1])}

    def enter(self, state, outline):
        end = first_piece_beyond(outline["pieces"], *state["anchor"][:2], Near(self.radius))
        if end is not None:
            return outline["states"][str(end)], False
        is_open = state["open"] or outline["last"] - state["anchor"][2] >= self.dwell_us
        return {"anchor": state["anchor"], "last": outline["last"], "open": is_open}, state["open"] == is_open


def usable_fixes(fixes: DataFrame, cfg: ClientConfig = ClientConfig()) -> DataFrame:
    """Drop fixes with poor accuracy and add `still`; unknown accuracy passes, unknown speed is still."""
    return fixes.filter(usable_fix(cfg.max_accuracy_m)).withColumn(
        "still", is_stationary(cfg.still_speed_mps)
    )


def detect_client_stops(
    fixes: DataFrame,
    cfg: ClientConfig = ClientConfig(),
    slicing: Slicing | None = None,
    tie: tuple = ("reading_id",),
) -> DataFrame:
    """Arrival and departure emissions of every device, as one batch in time order:
    (vehicle_id, event_id, kind, lat, lon, arrived_at, departed_at)."""
    usable = usable_fixes(fixes, cfg)
    slicing = resolve_slicing(usable, KEYS, "recorded_at", slicing)
    kernel = ClientKernel(cfg.radius_m, int(cfg.min_dwell_seconds * 1_000_000))
    found = fold(usable, KEYS, "recorded_at", list(tie), kernel, slicing)
    return shape_emissions(found)


def shape_emissions(found: DataFrame) -> DataFrame:
    return found.select(
        "vehicle_id",
        event_id("client", F.col("vehicle_id"), F.col("arrived_us")).alias("event_id"),
        "kind",
        "lat",
        "lon",
        F.timestamp_micros("arrived_us").alias("arrived_at"),
        F.timestamp_micros("departed_us").alias("departed_at"),
    )


def stops_from_emissions(emissions: DataFrame) -> DataFrame:
    """One client stop per event id; departed_at is NULL until a departure was emitted."""
    return (
        emissions.groupBy("event_id", "vehicle_id", "arrived_at", "lat", "lon")
        .agg(F.max("departed_at").alias("departed_at"))
        .select(
            F.col("event_id").alias("id"),
            "vehicle_id",
            F.lit("client").alias("source"),
            "arrived_at",
            "departed_at",
            "lat",
            "lon",
        )
    )


def emission_counts(emissions: DataFrame) -> DataFrame:
    """Per device: arrivals and departures emitted, and whether a stop is still open."""
    arrived = F.count_if(F.col("kind") == "arrived")
    departed = F.count_if(F.col("kind") == "departed")
    return emissions.groupBy("vehicle_id").agg(
        arrived.alias("arrived"), departed.alias("departed"), (arrived > departed).alias("open")
    )
