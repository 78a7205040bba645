import datetime as dt

import numpy as np
import pytest
from pyspark.sql import SparkSession

from wayfold import schema

BASE = dt.datetime(2026, 9, 1, 9, 0, tzinfo=dt.timezone.utc)
BASE_US = int(BASE.timestamp() * 1_000_000)
LAT, LON = 49.2827, -123.1207
DEGREE = 111_320.0


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def place(metres):
    return LAT + metres / DEGREE


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def make_positions(spark, rows):
    """rows: (vehicle, seconds, lat, lon[, speed[, accuracy[, battery[, motion]]]]) in id order."""
    full = []
    for i, r in enumerate(rows):
        vehicle, seconds, lat, lon, *rest = r
        speed, accuracy, battery, motion = [*rest, None, None, None, None][:4]
        full.append(
            (f"{i:08d}", vehicle, at(seconds), at(seconds), lat, lon, speed, None, accuracy, battery, motion)
        )
    return spark.createDataFrame(full, schema.POSITIONS)


def track(spark, samples, vehicle="v"):
    """samples: (seconds, metres north)."""
    return make_positions(spark, [(vehicle, s, place(m), LON) for s, m in samples])


def random_walk(rng, n, regime):
    """(seconds, lat, lon, speed) with stretches of parking, creeping, driving and silence."""
    t, north, east = 0.0, 0.0, 0.0
    out = []
    while len(out) < n:
        kind = rng.choice(regime)
        for _ in range(int(rng.integers(3, 40))):
            t += float(rng.choice([1, 5, 10, 10, 30]))
            speed = None
            if kind == "park":
                dn, de = rng.normal(0, 8, 2)
                out.append((t, north + dn, east + de, 0.0))
            elif kind == "scatter":
                dn, de = rng.normal(0, 28, 2)
                out.append((t, north + dn, east + de, None))
            elif kind == "creep":
                north += float(rng.uniform(0, 6))
                out.append((t, north, east, 0.8))
            else:
                north += float(rng.uniform(20, 180))
                east += float(rng.uniform(-30, 30))
                out.append((t, north, east, 12.0 if rng.random() < 0.9 else None))
        if kind == "gap" or rng.random() < 0.05:
            t += float(rng.integers(500, 4000))
    return [
        (s, float(LAT + a / DEGREE), float(LON + b / (DEGREE * np.cos(np.radians(LAT)))), v)
        for s, a, b, v in out[:n]
    ]


REGIMES = {
    "mixed": ["park", "drive", "creep", "scatter", "gap"],
    "parked": ["park"],
    "restless": ["scatter", "creep"],
    "moving": ["drive", "drive", "park"],
}


@pytest.fixture(scope="session")
def walks(spark):
    """Several vehicles, one of which owns over a third of the rows; as rows and as a DataFrame."""
    rng = np.random.default_rng(7)
    tracks = {}
    for name, regime in REGIMES.items():
        tracks[name] = random_walk(rng, 600 if name == "parked" else 300, regime)
    tracks["single"] = random_walk(rng, 1, ["drive"])
    tracks["hot"] = random_walk(rng, 1200, REGIMES["mixed"])
    rows = [(v, *sample) for v, samples in tracks.items() for sample in samples]
    df = make_positions(spark, rows)
    return tracks, df.repartition(5, "reading_id").cache()
