"""Incremental stop detection per device with state keyed by group of devices."""

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfold.config import ClientConfig
from wayfold.operators.client import advance, shape_emissions, usable_fixes

OUTPUT = "vehicle_id string, kind string, lat double, lon double, arrived_us bigint, departed_us bigint"
STATE = "vehicle_id string, anchor_lat double, anchor_lon double, anchor_us bigint, last_us bigint, is_open boolean"
#: Groups of devices that state is kept for; fixed for the life of a checkpoint. What a group costs a delivery does not grow
#: with its devices: a fleet of any size takes no more calls than this.
GROUPS = 1024
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Start the query inside this block: keyed state needs the RocksDB store."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class StopProcessor(StatefulProcessor):
    """Feeds each delivery of a group's devices, each in time order, to the detector states kept for them."""

    def __init__(self, cfg: ClientConfig):
        self.radius = cfg.radius_m
        self.dwell_us = int(cfg.min_dwell_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("detectors", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fixes = pd.concat(list(rows), ignore_index=True)
        codes, names = pd.factorize(fixes["vehicle_id"], use_na_sentinel=False)
        us = fixes["us"].to_numpy()
        order = np.lexsort((us, codes))
        us, lat, lon = us[order], fixes["lat"].to_numpy()[order], fixes["lon"].to_numpy()[order]
        still = fixes["still"].to_numpy(dtype=bool)[order]
        bounds = np.searchsorted(codes[order], np.arange(len(names) + 1))
        states, emitted = self._load(), []
        for name, a, b in zip(names, bounds[:-1], bounds[1:]):
            device = None if pd.isna(name) else name
            state, found = advance(states.pop(device, None), us[a:b], lat[a:b], lon[a:b], still[a:b], self.radius, self.dwell_us)
            if state is not None:
                states[device] = state
            emitted.extend((device, *e) for e in found)
        self._save(states)
        if emitted:
            out = pd.DataFrame(emitted, columns=["vehicle_id", "kind", "lat", "lon", "arrived_us", "departed_us"])
            out["arrived_us"] = out["arrived_us"].astype(np.int64)
            # Not by way of floats, which an absent departure would make of the others.
            out["departed_us"] = pd.array([e[-1] for e in emitted], dtype="Int64")
            yield out

    def _load(self) -> dict:
        return {
            device: {"anchor": [lat, lon, int(us)], "last": int(last), "open": bool(is_open)}
            for device, lat, lon, us, last, is_open in (self.state.get() if self.state.exists() else ())
        }

    def _save(self, states: dict) -> None:
        if states:
            self.state.put([(device, *s["anchor"], s["last"], s["open"]) for device, s in states.items()])
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def detect_stops_stream(fixes: DataFrame, cfg: ClientConfig = ClientConfig(), groups: int = GROUPS) -> DataFrame:
    """Emissions of a stream of fixes. A delivery is what one micro-batch holds for a device; it is
    sorted, and fixes older than the last one seen inside an open radius are dropped across
    deliveries. Bound a delivery with maxFilesPerTrigger or maxBytesPerTrigger on the source. Needs
    the RocksDB state store (rocksdb_state). No watermark: late backlog is legitimate input. State is kept by group of
    devices, as a call for each device costs far more than its few fixes."""
    usable = usable_fixes(fixes, cfg).select(
        F.pmod(F.xxhash64("vehicle_id"), F.lit(groups)).alias("device_group"), "vehicle_id", F.unix_micros("recorded_at").alias("us"), "lat", "lon", "still"
    )
    found = usable.groupBy("device_group").transformWithStateInPandas(
        statefulProcessor=StopProcessor(cfg),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None",
    )
    return shape_emissions(found)
