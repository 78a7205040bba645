"""What a load costs for each row."""

import datetime as dt
import json

from pyspark.sql import functions as F

from conftest import at
from wayfold.sources import batches as wire
from wayfold.streaming import ingest


def test_reasons_are_worked_out_once(spark, tmp_path, monkeypatch):
    """Answers and refusals of a load come from one pass that tells reasons."""
    told = {"reading": 0, "stop": 0}

    def counting(kind, rule):
        def counted(*args, **options):
            told[kind] += options.get("told", True)
            return rule(*args, **options)

        return counted

    for module in (ingest, wire):
        monkeypatch.setattr(module, "reading_reason", counting("reading", module.reading_reason))
        monkeypatch.setattr(module, "stop_reason", counting("stop", module.stop_reason))
    stamp = (at(0)).astimezone(dt.timezone.utc).isoformat()
    reading = {"recorded_at": stamp, "lat": 49.0, "lon": -123.0}
    stop = {"arrived_at": stamp, "lat": 49.0, "lon": -123.0}
    sent = [
        {"device_id": "d", "readings": [{**reading, "reading_id": "r1"}, {**reading, "reading_id": "r2", "lat": 99.0}, {**reading}],
         "stop_events": [{**stop, "event_id": "e1"}, {**stop, "event_id": "e2", "lon": 181.0}]},
        {"device_id": "", "readings": [{**reading, "reading_id": "r3"}]},
        {"device_id": "d", "readings": [{**reading, "reading_id": "r4", "recorded_at": "2026-09-01 09:00:00"}]},
        {"device_id": "d", "sent_at": "never", "readings": [{**reading, "reading_id": "r5"}]},
        {"device_id": "d", "stop_events": [{**stop, "event_id": "e3", "departed_at": "2026-13-01T00:00:00Z"}]},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(b) for b in sent))
    target = ingest.Target(str(tmp_path / "tables"))
    ingest.ingest_batch(target, wire.read_batches(spark, f"{tmp_path}/in"), 0, F.lit(at(60)), "s")
    assert told == {"reading": 1, "stop": 1}
    refused = sorted((r["kind"], r["id"], r["reason"]) for r in spark.read.parquet(target.path("rejected")).collect())
    assert refused == [
        ("batch", "", "device_id is required"),
        *[("batch", "d", "malformed JSON")] * 3,
        ("reading", "00000000-0000-0000-0000-000000000000", "reading_id is required"),
        ("reading", "r2", "lat 99 out of range [-90, 90]"),
        ("stop", "e2", "lon 181 out of range [-180, 180]"),
    ]
    audit = spark.read.parquet(target.path("audit")).first()
    assert (audit.enqueued, audit.inserted, audit.refused) == (1, 1, 7)
