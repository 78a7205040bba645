"""Late rows: deriving their neighbourhood again equals deriving everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import at, make_positions, random_walk
from wayfold.operators.ordered import WHOLE, Slicing
from wayfold.operators.trips import detect
from wayfold.plans.dirty import dirty_ranges, rederive
from wayfold.session import materialise


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    out = []
    for v in ("a", "b", "c", "d"):
        for day in range(4):  # days far apart in time and place
            out += [(v, day * 86_400 + s, lat + day * 0.5, lon, speed) for s, lat, lon, speed in random_walk(rng, 60, ["park", "drive", "gap"])]
    return make_positions(spark, out).cache()


LATE = {
    "one fix": "vehicle_id = 'a' AND substr(reading_id, 6) = '100'",
    "a stretch": "vehicle_id = 'b' AND cast(reading_id AS int) BETWEEN 320 AND 345",
    "the beginning": "vehicle_id = 'c' AND cast(reading_id AS int) BETWEEN 480 AND 490",
    "the end": "vehicle_id = 'd' AND cast(reading_id AS int) >= 950",
    "everywhere": "cast(reading_id AS int) % 40 = 7",
    "a whole vehicle": "vehicle_id = 'b'",
    "nothing": "false",
}


@pytest.mark.parametrize("name", LATE)
def test_neighbourhood_equals_everything(spark, rows, name):
    late = F.expr(LATE[name])
    rows = rows.withColumn("received_at", F.when(late, F.lit(at(900_000))).otherwise(F.lit(at(800_000))))
    trips, stops = (materialise(x) for x in detect(rows.filter(~late), slicing=WHOLE))
    ranges = materialise(dirty_ranges(rows, F.lit(at(850_000))))
    got = rederive(rows, trips, stops, ranges, slicing=WHOLE if name == "a stretch" else Slicing(7_200_000_000))
    for found, want in zip(got, detect(rows, slicing=WHOLE)):
        shaped = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.select(*want.columns).collect())  # noqa: B023, E731
        assert shaped(found) == shaped(want)
    if name in ("one fix", "a stretch"):
        row = ranges.first()
        assert ranges.count() == 1 and row.from_us is not None and row.to_us is not None
        assert row.to_us - row.from_us <= 2 * 86_400_000_000
