"""The first write of an id carries its row once."""

from pyspark.sql import functions as F

from conftest import at, track
from wayfold.operators.load import first_writes


def test_a_first_write_carries_its_row_once(spark):
    batch = track(spark, [(0, 0), (10, 5)])
    again = batch.withColumn("lat", F.lit(0.0)).withColumn("received_at", F.lit(at(5)))
    firsts = first_writes(batch.unionByName(again), "reading_id", ["received_at"])
    assert firsts.columns == batch.columns
    assert {(r["reading_id"], r["lat"] == 0.0) for r in firsts.collect()} == {("00000000", False), ("00000001", True)}
    assert "min_by" not in firsts._jdf.queryExecution().optimizedPlan().toString()
