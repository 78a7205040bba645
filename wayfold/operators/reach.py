"""Where the samples after a point first leave its surroundings, for many points at once, and what that says about a slice.

Samples lie in blocks of doubling size with their bounds. A search goes forward in blocks that lie inside as a whole and
halves the block that may not, so it costs the logarithm of the distance travelled instead of the distance.
"""

import numpy as np

from wayfold.functions.geo import METRES_PER_DEGREE, np_equirect_m, np_haversine_m

#: Beyond these a set of points is kept whole, since the plane no longer tells which of them are outermost.
HIGHEST_LAT, WIDEST_RADIUS_M = 85.0, 100_000.0


class Near:
    """Within a great-circle distance, the bound included."""

    def __init__(self, radius: float):
        self.radius = radius

    def holds(self, lat, lon, to_lat, to_lon):
        return np_haversine_m(lat, lon, to_lat, to_lon) <= self.radius


class Closer:
    """Closer than a flat distance, the bound excluded."""

    def __init__(self, radius: float):
        self.radius = radius

    def holds(self, lat, lon, to_lat, to_lon):
        return np_equirect_m(lat, lon, to_lat, to_lon) < self.radius


ANGLES = np.arange(16) * (2 * np.pi / 16)
DIRECTIONS = np.array([np.cos(ANGLES), np.sin(ANGLES)])
#: No point is farther away than the farthest in one of the directions, divided by this.
SLACK = np.cos(np.pi / 16)


class Blocks:
    """How far the aligned blocks of 1, 2, 4, ... samples reach in 16 directions, all levels in one array.

    They are laid out on a plane where nothing is nearer than it is on the ground: longitudes are scaled for the
    parallel nearest the equator. So a block near on the plane is near, and where that does not settle it single samples do.
    """

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        self.lat, self.lon, self.n = lat, lon, len(lat)
        self.scale = np.array([METRES_PER_DEGREE, METRES_PER_DEGREE * np.cos(np.radians(np.abs(lat).min() if len(lat) else 0))])
        self.centre = np.array([lat[0], lon[0]]) if len(lat) else np.zeros(2)
        levels, offset = [self._along(lat, lon)], [0]
        while len(levels[-1]) > 1:
            last = levels[-1]
            if len(last) % 2:
                last = np.vstack([last, last[-1:]])
            offset.append(offset[-1] + len(levels[-1]))
            levels.append(np.maximum(last[::2], last[1::2]))
        self.reach, self.offset, self.top = np.concatenate(levels), np.array(offset), len(levels) - 1

    def _along(self, lat, lon) -> np.ndarray:
        flat = (np.column_stack([lat, lon]) - self.centre) * self.scale
        return (flat @ DIRECTIONS).astype(np.float32)

    def first_beyond(self, lat, lon, start, rule, until=None) -> np.ndarray:
        """For each point, the first sample from its start on for which the rule does not hold, or the number of samples.

        With until, a search ends there: any answer from until on says no more than that it is none before.
        """
        out = np.minimum(np.asarray(start), self.n)
        until = np.full(len(out), self.n) if until is None else until
        lat, lon = np.broadcast_to(lat, out.shape), np.broadcast_to(lon, out.shape)
        own = self._along(lat, lon)
        # A float32 may be off by some metres far from the centre.
        near = rule.radius * SLACK * (1 - 1e-6) - 1e-6 - 4e-7 * (np.abs(self.reach).max(initial=0) + np.abs(own).max(initial=0))
        live = np.flatnonzero(out < until)
        level = np.zeros(len(live), np.int64)
        while len(live):
            at = out[live]
            inside = (self.reach[self.offset[level] + (at >> level)] - own[live]).max(axis=1) <= near
            unsure = np.flatnonzero(~inside & (level == 0))
            k = live[unsure]
            inside[unsure] = rule.holds(lat[k], lon[k], self.lat[at[unsure]], self.lon[at[unsure]])
            at = np.where(inside, at + (1 << level), at)
            out[live] = np.minimum(at, self.n)
            # Further on, in a block twice as large where one begins; else into the first half of this one.
            larger = inside & ((at & ((2 << level) - 1)) == 0)
            level = np.minimum(level + larger - ~inside, self.top)
            going = (level >= 0) & (at < until[live])
            live, level = live[going], level[going]
        return out


def ends_of(successor: np.ndarray) -> np.ndarray:
    """For each place, the last one that successors lead to; a place that is its own successor is a last one."""
    while True:
        further = successor[successor]
        if (further == successor).all():
            return successor
        successor = further


def outermost(lat: np.ndarray, lon: np.ndarray, radius: float) -> list[list[float]]:
    """Points that lie within a small circle only if all points do: the corners of their convex hull."""
    points = np.unique(np.column_stack([lat, lon]), axis=0)
    if len(points) < 4 or np.abs(points[:, 0]).max() > HIGHEST_LAT or radius > WIDEST_RADIUS_M or np.ptp(points[:, 1]) > 90:
        return points.tolist()
    if len(points) > 64:
        # What lies inside the polygon of the outermost points in some directions is no corner.
        angle = np.linspace(0, 2 * np.pi, 32, endpoint=False)
        centre, scale = points.mean(axis=0), np.ptp(points, axis=0)
        flat = (points - centre) / np.where(scale > 0, scale, 1)
        ring = flat[np.argmax(flat @ np.array([np.cos(angle), np.sin(angle)]), axis=0)]
        ring = ring[(ring != np.roll(ring, 1, axis=0)).any(axis=1)]
        along = np.roll(ring, -1, axis=0) - ring
        left = [along[k, 0] * (flat[:, 1] - ring[k, 1]) - along[k, 1] * (flat[:, 0] - ring[k, 0]) for k in range(len(ring))]
        points = points[(np.min(left, axis=0) <= 1e-12)] if len(ring) > 2 else points
    corners = []
    for ordered in (points.tolist(), points[::-1].tolist()):
        chain: list[list[float]] = []
        for p in ordered:
            while len(chain) > 1 and _turns_right(chain[-2], chain[-1], p):
                chain.pop()
            chain.append(p)
        corners += chain[:-1]
    return corners


def _turns_right(a: list[float], b: list[float], c: list[float]) -> bool:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) < 0


def pieces_of(ends: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius: float) -> list[list]:
    """Runs of rows from which the walk ends in one way: [end, corners of the rows' points], in order."""
    edges = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])).tolist()
    return [[int(ends[a]), outermost(lat[a:b], lon[a:b], radius)] for a, b in zip(edges, [*edges[1:], len(ends)])]


def first_piece_beyond(pieces: list[list], lat: float, lon: float, rule) -> int | None:
    """The end that the walk comes to once it leaves the point's surroundings; None if no row does that."""
    for end, corners in pieces:
        c = np.array(corners).T
        if not rule.holds(lat, lon, c[0], c[1]).all():
            return end
    return None
