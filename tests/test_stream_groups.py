"""Streaming detection with state by group of devices."""

import pandas as pd
from pyspark.sql import functions as F

from test_sources import run_stream
from wayfold.config import ClientConfig
from wayfold.operators.client import detect_client_stops
from wayfold.operators.ordered import WHOLE
from wayfold.streaming import stops as stream_stops


class Kept:
    """List state as the store would keep it, with the number of calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def getListState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def clear(self):
        self.calls += 1
        self.rows = []


def test_a_delivery_of_many_devices_is_one_call():
    kept, processor = Kept(), stream_stops.StopProcessor(ClientConfig())
    processor.init(kept)
    devices = [f"d{k}" for k in range(500)] + [None]
    for turn, (seconds, still) in enumerate((((60, 0), True), ((120, 180), True), ((240, 241), False))):
        fixes = [(d, s * 1_000_000, 49.0 + (turn == 2), -123.0, still) for s in seconds for d in devices]
        frame = pd.DataFrame(fixes, columns=["vehicle_id", "us", "lat", "lon", "still"])
        out = list(processor.handleInputRows((0,), iter((frame[:300], frame[300:])), None))
        assert kept.calls <= 3 * (turn + 1)
        assert len(out) == (turn > 0)
        if out:
            assert sorted(out[0]["vehicle_id"], key=str) == sorted(devices, key=str)
            assert set(out[0]["kind"]) == {"arrived" if turn == 1 else "departed"}
            left = set(out[0]["departed_us"].fillna(-1))
            assert left == ({-1} if turn == 1 else {180_000_000})
        assert len(kept.rows) == (len(devices) if turn < 2 else 0)


def test_devices_of_one_group_stay_apart(spark, walks, tmp_path, monkeypatch):
    _, p = walks
    monkeypatch.setattr(stream_stops.detect_stops_stream, "__defaults__", (ClientConfig(), 2))
    moment = F.unix_seconds("recorded_at")
    first, last = p.agg(F.min(moment), F.max(moment)).first()
    step = (last - first) // 3 + 1
    deliveries = [p.filter(F.floor((moment - first) / step) == k) for k in range(3)]
    got, want = run_stream(spark, p, str(tmp_path), deliveries), detect_client_stops(p, slicing=WHOLE)
    assert want.select("vehicle_id").distinct().count() > 2
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
