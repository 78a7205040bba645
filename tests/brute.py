"""The ordered rules worked out another way, to compare with: tables of next places, followed afterwards."""

import bisect
import itertools

import numpy as np

RADIUS_OF_EARTH = 6_371_000.0


def metres(samples):
    """Distances between all samples, as a matrix."""
    lat, lon = np.radians([[s[1], s[2]] for s in samples]).T
    half = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    return 2 * RADIUS_OF_EARTH * np.arcsin(np.sqrt(np.minimum(1.0, half)))


def first_after(hits):
    """For each row of a square table, the first place behind the diagonal that is True, or the size of the table."""
    later = np.triu(hits, 1)
    return np.where(later.any(axis=1), later.argmax(axis=1), len(hits))


def followed(successor, start):
    """Places from start on, each the successor of the one before, as long as they lie in the table."""
    place = start
    while place < len(successor):
        yield place
        place = int(successor[place])


def stops(samples, radius=50.0, dwell=120.0):
    """(arrived, departed or None) in seconds."""
    times = np.array([s[0] for s in samples])
    leaves = first_after(metres(samples) > radius)
    lasting = times[leaves - 1] - times >= dwell
    successor = np.where(lasting, leaves, np.arange(len(samples)) + 1)
    return [
        (samples[k][0], samples[leaves[k] - 1][0] if leaves[k] < len(samples) else None)
        for k in followed(successor, 0) if lasting[k]
    ]


def trips(samples, found, gap=600.0):
    """(started, ended, metres)."""
    times = [s[0] for s in samples]
    parked = np.zeros(len(samples) + 1, dtype=int)
    for arrived, departed in found:
        parked[bisect.bisect_left(times, arrived)] += 1
        parked[len(times) if departed is None else bisect.bisect_right(times, departed)] -= 1
    moving = np.cumsum(parked)[:-1] == 0
    broken = np.concatenate([[True], (np.diff(times) > gap) | ~moving[:-1]])
    labels = np.cumsum(broken)
    step = metres(samples).diagonal(1)
    out = []
    for _, group in itertools.groupby(np.flatnonzero(moving).tolist(), key=lambda k: labels[k]):
        places = list(group)
        first, last = places[0], places[-1]
        if last > first:
            out.append((times[first], times[last], float(step[first:last].sum())))
    return out


def link(found, made):
    """The start of the trip that ended last before each stop."""
    made = sorted(made, key=lambda t: t[1])
    before = [bisect.bisect_right([t[1] for t in made], arrived) for arrived, _ in found]
    return [made[k - 1][0] if k else None for k in before]


def client(samples, radius=50.0, dwell=90.0, still=1.0):
    """(kind, arrived, departed or None), from the interval that each still sample would dwell."""
    times = np.array([s[0] for s in samples])
    leaves = first_after(metres(samples) > radius)
    rests = [k for k, s in enumerate(samples) if s[3] is None or s[3] <= still]
    next_rest = np.array([*rests, len(samples)])[np.searchsorted(rests, np.arange(len(samples) + 1))]
    out = []
    for k in followed(next_rest[leaves], int(next_rest[0])):
        if times[leaves[k] - 1] - times[k] >= dwell:
            out.append(("arrived", samples[k][0], None))
            if leaves[k] < len(samples):
                out.append(("departed", samples[k][0], samples[leaves[k] - 1][0]))
    return out


def thin(samples, least=15.0):
    """Times kept."""
    place = np.array([[s[1], s[2]] for s in samples])
    known = np.flatnonzero(np.isfinite(place).all(axis=1))
    lat, lon = place[known].T if len(known) else (np.zeros(0), np.zeros(0))
    flat = np.hypot(lat - lat[:, None], (lon - lon[:, None]) * np.cos(np.radians(lat))) * 111_320
    kept = {int(known[k]) for k in followed(first_after(flat >= least), 0)} | {len(samples) - 1}
    return [s[0] for k, s in enumerate(samples) if k in kept or len(samples) <= 2]


def tiers(wanted, dwell=120.0):
    """wanted: (seconds, tier); returns the changes. A run of one wish decides by itself whether and when it is granted."""
    now, out = "active", []
    for wish, run in itertools.groupby(wanted, key=lambda x: x[1]):
        times = [t for t, _ in run]
        granted = times[:1] if wish == "active" else [t for t in times[1:] if t - times[0] >= dwell][:1]
        if wish != now and granted:
            now = wish
            out.append((granted[0], wish))
    return out
