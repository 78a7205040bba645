"""Stop detection: a fixed anchor, a radius and a minimum dwell."""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.config import DetectConfig
from wayfold.functions.geo import haversine, np_haversine_m
from wayfold.operators.fold import US, fold
from wayfold.operators.ordered import Slicing, resolve_slicing
from wayfold.operators.reach import Blocks, Near, ends_of, first_piece_beyond, pieces_of

KEYS = ["vehicle_id"]


def first_outside(lat, lon, start, at_lat, at_lon, radius):
    """Index of the first point from `start` on that lies beyond radius, or None."""
    n = len(lat)
    near = min(n, start + 4)
    for i in range(start, near):
        if not haversine(at_lat, at_lon, float(lat[i]), float(lon[i])) <= radius:
            return i
    start, step = near, 32
    while start < n:
        end = min(n, start + step)
        far = ~(np_haversine_m(at_lat, at_lon, lat[start:end], lon[start:end]) <= radius)
        hit = int(np.argmax(far))
        if far[hit]:
            return start + hit
        start, step = end, step * 4
    return None


def first_jump(us, lat, lon, least):
    """First row later than the one before it and more than `least` metres away, or None."""
    if len(us) < 2:
        return None
    step = np_haversine_m(lat[:-1], lon[:-1], lat[1:], lon[1:])
    hits = np.flatnonzero((step > least) & (us[1:] > us[:-1]))
    return int(hits[0]) + 1 if len(hits) else None


def dwelling(us, lat, lon, radius, dwell_us):
    """For each sample as an anchor: does its run last dwell_us, and does it reach the last sample
    before that is known? A run is the samples following the anchor that stay within radius."""
    n = len(us)
    due = np.searchsorted(us, us + dwell_us)
    if dwell_us <= 0:
        return np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    leaves = Blocks(lat, lon).first_beyond(lat, lon, np.arange(n) + 1, Near(radius), np.minimum(due + 1, n))
    lasting = (due < n) & (leaves > due)
    return lasting, (leaves >= n) & ~lasting


@dataclass
class StopKernel:
    """State: a stop in progress {stop: [lat, lon, us], last: us}, or {tail: [[us], [lat], [lon]]},
    the samples whose own run is still too short to judge; they span less than the minimum dwell."""

    radius: float
    dwell_us: int
    columns: tuple = ("lat", "lon")
    mark: str = "arrived_us"
    fields: dict = field(
        default_factory=lambda: {
            "arrived_us": "bigint",
            "departed_us": "bigint",
            "lat": "double",
            "lon": "double",
        }
    )

    def run(self, state, cols):
        us, lat, lon = cols[US], cols["lat"], cols["lon"]
        found = []
        at = 0
        if state and "stop" in state:
            out = first_outside(lat, lon, 0, state["stop"][0], state["stop"][1], self.radius)
            if out is None:
                return {"stop": state["stop"], "last": int(us[-1])}, {}
            found.append((state["stop"], int(us[out - 1]) if out else state["last"]))
            at = out
        elif state:
            tail_us, tail_lat, tail_lon = state["tail"]
            us = np.concatenate([np.array(tail_us, dtype=us.dtype), us])
            lat = np.concatenate([np.array(tail_lat), lat])
            lon = np.concatenate([np.array(tail_lon), lon])
        n, left = len(us), None
        lasting, unknown = dwelling(us, lat, lon, self.radius, self.dwell_us)
        anchors = np.flatnonzero(lasting | unknown)
        while at < n:
            k = np.searchsorted(anchors, at)
            if k == len(anchors):
                break
            a = int(anchors[k])
            if not lasting[a]:
                left = {"tail": [us[a:].tolist(), lat[a:].tolist(), lon[a:].tolist()]}
                break
            anchor = [float(lat[a]), float(lon[a]), int(us[a])]
            out = first_outside(lat, lon, a + 1, anchor[0], anchor[1], self.radius)
            if out is None:
                left = {"stop": anchor, "last": int(us[-1])}
                break
            found.append((anchor, int(us[out - 1])))
            at = out
        return left, _stop_rows(found)

    def finish(self, state):
        return _stop_rows([(state["stop"], None)]) if state and "stop" in state else {}

    def cut_off(self, state):
        return _stop_rows([(state["stop"], state["last"])]) if state and "stop" in state else {}

    def cut(self, cols):
        # No run holds two points further apart than twice the radius.
        return first_jump(cols[US], cols["lat"], cols["lon"], 2 * self.radius * (1 + 1e-9))

    def outline(self, cols):
        """The first samples, as far as a tail may ask for them, and where the walk ends if it starts at a row of the slice:
        [rows from which it ends so, by their outermost points] and the states of these ends."""
        us, lat, lon = cols[US], cols["lat"], cols["lon"]
        n = len(us)
        lasting, unknown = dwelling(us, lat, lon, self.radius, self.dwell_us)
        anchors = np.flatnonzero(lasting)
        leaves = Blocks(lat, lon).first_beyond(lat[anchors], lon[anchors], anchors + 1, Near(self.radius))
        successor = np.minimum(np.arange(n + 1) + 1, n)
        successor[anchors] = np.where(leaves < n, leaves, anchors)  # a stop still open is an end
        successor[:n][unknown] = np.flatnonzero(unknown)
        ends = ends_of(successor)
        states = {}
        for end in np.unique(ends).tolist():
            if end < n and lasting[end]:
                states[end] = {"stop": [float(lat[end]), float(lon[end]), int(us[end])], "last": int(us[-1])}
            elif end < n:
                states[end] = {"tail": [us[end:].tolist(), lat[end:].tolist(), lon[end:].tolist()]}
            else:
                states[end] = None
        head = min(n, int(np.searchsorted(us, us[0] + self.dwell_us)) + 1)
        return {
            "pieces": pieces_of(ends[:n], lat, lon, self.radius), "states": states, "last": int(us[-1]), "whole": head == n,
            "head": [us[:head].tolist(), lat[:head].tolist(), lon[:head].tolist()], "ends": ends[:head].tolist(),
        }

    def enter(self, state, outline):
        if "tail" in state:
            return self._enter_tail(state["tail"], outline)
        return self._enter_stop(state["stop"], outline)

    def _enter_stop(self, anchor, outline):
        end = first_piece_beyond(outline["pieces"], anchor[0], anchor[1], Near(self.radius))
        if end is None:
            return {"stop": anchor, "last": outline["last"]}, True
        return outline["states"][str(end)], False

    def _enter_tail(self, tail, outline):
        """Samples of a tail are tried as anchors over the tail and the slice's first samples; these reach far enough to
        tell whether a run lasts."""
        us, lat, lon = (np.array([*a, *b]) for a, b in zip(tail, outline["head"]))
        size, at = len(tail[0]), 0
        while at < size:
            out = first_outside(lat, lon, at + 1, float(lat[at]), float(lon[at]), self.radius)
            last = len(us) - 1 if out is None else out - 1
            if us[last] - us[at] < self.dwell_us:
                if out is None:
                    # The slice ends before that is known.
                    return {"tail": [us[at:].tolist(), lat[at:].tolist(), lon[at:].tolist()]}, True
                at += 1
            elif out is None:
                return self._enter_stop([float(lat[at]), float(lon[at]), int(us[at])], outline)[0], False
            else:
                at = out
        return outline["states"][str(outline["ends"][at - size])], False


def _stop_rows(found):
    return {
        "arrived_us": [anchor[2] for anchor, _ in found],
        "departed_us": [departed for _, departed in found],
        "lat": [anchor[0] for anchor, _ in found],
        "lon": [anchor[1] for anchor, _ in found],
    }


def event_id(kind: str, *parts):
    """Deterministic id, so a recomputed window yields the ids it had before."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *parts), 256)


def detect_stops(
    positions: DataFrame, cfg: DetectConfig = DetectConfig(), slicing: Slicing | None = None
) -> DataFrame:
    """Stops of every vehicle: (id, vehicle_id, source, arrived_at, departed_at, lat, lon).

    A stop is a maximal run of samples within stop_radius_m of its first sample lasting at least
    stop_min_seconds. departed_at is NULL when the run reaches the vehicle's last sample.
    """
    slicing = resolve_slicing(positions, KEYS, "recorded_at", slicing)
    kernel = StopKernel(cfg.stop_radius_m, int(cfg.stop_min_seconds * 1_000_000))
    found = fold(positions, KEYS, "recorded_at", ["reading_id"], kernel, slicing)
    return found.select(
        event_id("stop", F.col("vehicle_id"), F.col("arrived_us")).alias("id"),
        "vehicle_id",
        F.lit("derived").alias("source"),
        F.timestamp_micros("arrived_us").alias("arrived_at"),
        F.timestamp_micros("departed_us").alias("departed_at"),
        "lat",
        "lon",
    )
