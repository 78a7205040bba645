"""Routes for display: merge the device's rows with the server's, thin them, frame them."""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.config import FALLBACK_CAMERA
from wayfold.functions.geo import METRES_PER_DEGREE, np_equirect_m, zoom_for_span
from wayfold.functions.mapping import route_source
from wayfold.functions.predicates import is_finite
from wayfold.operators.fold import US, fold
from wayfold.operators.ordered import Slicing, resolve_slicing
from wayfold.operators.reach import Blocks, Closer, ends_of, first_piece_beyond, pieces_of


@dataclass
class ThinKernel:
    """State: {n: rows seen (counted to 3), kept: last kept [lat, lon], held: rows passed over while
    n <= 2, final: the last row if it was passed over}. A row is [us, reading_id, lat, lon]."""

    min_m: float
    columns: tuple = ("reading_id", "lat", "lon")
    mark: str = "us"
    fields: dict = field(
        default_factory=lambda: {"us": "bigint", "reading_id": "string", "lat": "double", "lon": "double"}
    )

    def run(self, state, cols):
        us, rid, lat, lon = cols[US], cols["reading_id"], cols["lat"], cols["lon"]
        state = state or {"n": 0, "kept": None, "held": [], "final": None}
        finite = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
        chosen = finite[self._kept(lat[finite], lon[finite], state["kept"])]
        n = min(3, state["n"] + len(us))
        skipped = np.ones(len(us), dtype=bool)
        skipped[chosen] = False

        def row(i):
            return [int(us[i]), str(rid[i]), float(lat[i]), float(lon[i])]

        held = state["held"] + [row(i) for i in np.flatnonzero(skipped[:2])] if n <= 2 else []
        kept = [float(lat[chosen[-1]]), float(lon[chosen[-1]])] if len(chosen) else state["kept"]
        final = row(len(us) - 1) if skipped[-1] else None
        out = {"us": us[chosen], "reading_id": rid[chosen], "lat": lat[chosen], "lon": lon[chosen]}
        return {"n": n, "kept": kept, "held": held, "final": final}, out

    def _kept(self, lat, lon, last):
        """Indices kept: each at least min_m from the one kept before it."""
        n = len(lat)
        if n == 0:
            return np.empty(0, dtype=int)
        far = np.ones(n, dtype=bool)
        far[1:] = np_equirect_m(lat[:-1], lon[:-1], lat[1:], lon[1:]) >= self.min_m
        breaks = np.flatnonzero(~far)
        pieces = []
        at = 0 if last is None else self._next(lat, lon, 0, *last)
        while at is not None and at < n:
            # From a kept point on, every next point a full step away is kept too.
            k = np.searchsorted(breaks, at, side="right")
            stop = int(breaks[k]) if k < len(breaks) else n
            pieces.append(np.arange(at, stop))
            at = self._next(lat, lon, stop, lat[stop - 1], lon[stop - 1])
        return np.concatenate(pieces) if pieces else np.empty(0, dtype=int)

    def _next(self, lat, lon, start, from_lat, from_lon):
        n, step = len(lat), 16
        while start < n:
            end = min(n, start + step)
            far = np_equirect_m(from_lat, from_lon, lat[start:end], lon[start:end]) >= self.min_m
            hit = int(np.argmax(far))
            if far[hit]:
                return start + hit
            start, step = end, step * 4
        return None

    def finish(self, state):
        rows = state["held"] if state["n"] <= 2 else [state["final"]] if state["final"] else []
        return {name: [r[i] for r in rows] for i, name in enumerate(self.fields)}

    def cut_off(self, state):
        return {}

    def cut(self, cols):
        # A point two steps away from its predecessor is kept whichever point was kept before. The
        # one per cent covers the flat distance not being a metric.
        us, lat, lon = cols[US], cols["lat"], cols["lon"]
        if len(us) < 3:
            return None
        far = np_equirect_m(lat[:-1], lon[:-1], lat[1:], lon[1:]) > 2 * self.min_m * 1.01
        hits = np.flatnonzero(far & (us[1:] > us[:-1]))
        return int(hits[0]) + 1 if len(hits) else None

    def outline(self, cols):
        """Which point is the last one kept if a row is, by the rows' outermost points; the slice's rows as far as a route
        of one or two rows needs them."""
        us, rid, lat, lon = cols[US], cols["reading_id"], cols["lat"], cols["lon"]
        finite = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
        n, y, x = len(finite), lat[finite], lon[finite]
        leaves = Blocks(y, x).first_beyond(y, x, np.arange(n) + 1, Closer(self.min_m)) if n else finite
        ends = ends_of(np.where(leaves < n, leaves, np.arange(n)))

        def row(i):
            return [int(us[i]), str(rid[i]), float(lat[i]), float(lon[i])]

        return {
            "pieces": pieces_of(ends, y, x, self.min_m) if n else [], "kept": {e: [float(y[e]), float(x[e])] for e in np.unique(ends).tolist()},
            "last_end": n - 1 if n and finite[-1] == len(us) - 1 else None, "rows": len(us), "final": row(len(us) - 1),
            "head": [row(i) for i in range(min(2, len(us)))],
        }

    def enter(self, state, outline):
        rows, kept = outline["rows"], state["kept"]
        n = min(3, state["n"] + rows)
        if n <= 2:
            # A second row after a first: like any run of two rows.
            us, rid, lat, lon = (np.array(x) for x in zip(*outline["head"]))
            return self.run(state, {US: us, "reading_id": rid, "lat": lat, "lon": lon})[0], False
        if kept is None:
            end = outline["pieces"][0][0] if outline["pieces"] else None
        else:
            end = first_piece_beyond(outline["pieces"], *kept, Closer(self.min_m))
        if end is not None:
            kept = outline["kept"][str(end)]
        final = None if end is not None and end == outline["last_end"] else outline["final"]
        return {"n": 3, "kept": kept, "held": [], "final": final}, end is None


def thin(
    positions: DataFrame,
    keys: tuple = ("vehicle_id",),
    min_m: float = 15.0,
    slicing: Slicing | None = None,
) -> DataFrame:
    """Drop route points closer than min_m to the last one kept; the last point of a route stays."""
    keys = list(keys)
    slicing = resolve_slicing(positions, keys, "recorded_at", slicing)
    kept = fold(positions, keys, "recorded_at", ["reading_id"], ThinKernel(min_m), slicing)
    return kept.select(*keys, "reading_id", F.timestamp_micros("us").alias("recorded_at"), "lat", "lon")


def bounds(positions: DataFrame, keys: tuple = ("vehicle_id",)) -> DataFrame:
    """Bounding box of the finite points of every key; NULLs when it has none."""
    usable = is_finite("lat") & is_finite("lon")
    lat, lon = F.when(usable, F.col("lat")), F.when(usable, F.col("lon"))
    return positions.groupBy(*keys).agg(
        F.min(lat).alias("min_lat"),
        F.max(lat).alias("max_lat"),
        F.min(lon).alias("min_lon"),
        F.max(lon).alias("max_lon"),
    )


def camera(positions: DataFrame, keys: tuple = ("vehicle_id",), margin: float = 1.2) -> DataFrame:
    """Map centre and zoom that frame every key's points."""
    lat_span = (F.col("max_lat") - F.col("min_lat")) * margin
    lon_span = (F.col("max_lon") - F.col("min_lon")) * margin
    lat, lon, zoom = FALLBACK_CAMERA
    return bounds(positions, keys).select(
        *keys,
        F.coalesce((F.col("min_lat") + F.col("max_lat")) / 2, F.lit(lat)).alias("latitude"),
        F.coalesce((F.col("min_lon") + F.col("max_lon")) / 2, F.lit(lon)).alias("longitude"),
        F.coalesce(zoom_for_span(lat_span, lon_span), F.lit(zoom)).alias("zoom"),
    )


def merge_positions(local: DataFrame, server: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged rows, per-vehicle statistics). One row per reading_id; the server's copy wins."""
    columns = [c for c in local.columns if c in server.columns]
    tagged = local.select(*columns, F.lit(1).alias("_prio")).unionByName(
        server.select(*columns, F.lit(0).alias("_prio"))
    )
    best = F.min_by(F.struct(*columns), F.struct("_prio", *columns)).alias("r")
    merged = tagged.groupBy(F.col("reading_id").alias("_key")).agg(
        best,
        F.count_if(F.col("_prio") == 1).alias("_local"),
        F.count_if(F.col("_prio") == 0).alias("_server"),
    )
    stats = (
        merged.groupBy("r.vehicle_id")
        .agg(
            F.sum("_local").alias("local_rows"),
            F.sum("_server").alias("server_rows"),
            F.sum(F.when((F.col("_local") > 0), F.col("_server")).otherwise(0)).alias("_both"),
        )
        .select(
            "vehicle_id",
            "local_rows",
            "server_rows",
            (F.col("local_rows") - F.col("_both")).alias("local_only"),
            route_source("local_rows", "server_rows").alias("source"),
        )
    )
    return merged.select("r.*"), stats
