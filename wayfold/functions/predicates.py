"""Row predicates and window arguments."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.config import DEFAULT_WINDOW_HOURS, SOURCES


def at(moment) -> Column:
    """A timestamp literal from a Column, a datetime or epoch microseconds."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, int):
        return F.timestamp_micros(F.lit(moment))
    return F.lit(moment)


def in_window(column: str, frm, to) -> Column:
    """frm <= column < to."""
    return (F.col(column) >= at(frm)) & (F.col(column) < at(to))


def overlaps(start: str, end: str, frm, to, now) -> Column:
    """The span [start, end] touches [frm, to); an open span (NULL end) lasts until `now`."""
    return (F.col(start) < at(to)) & (F.coalesce(F.col(end), at(now)) >= at(frm))


def source_is(source: str = "") -> Column:
    """Keep one source, or both when source is empty."""
    if source == "":
        return F.lit(True)
    if source not in SOURCES:
        raise ValueError(f"source must be one of {SOURCES} or empty, not {source!r}")
    return F.col("source") == source


def usable_fix(max_accuracy_m: float) -> Column:
    return F.col("accuracy_m").isNull() | (F.col("accuracy_m") <= max_accuracy_m)


def is_stationary(max_speed_mps: float) -> Column:
    return F.col("speed_mps").isNull() | (F.col("speed_mps") <= max_speed_mps)


def is_finite(column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def window_for(now: dt.datetime, lookback: dt.timedelta):
    """The derivation window [now - lookback, now)."""
    return now - lookback, now


def resolve_window(frm: str | dt.datetime | None, to: str | dt.datetime | None, now: dt.datetime):
    """Window from optional RFC 3339 bounds, by default the last 24 hours; frm must precede to."""
    end = _moment("to", to) or now
    start = _moment("from", frm) or now - dt.timedelta(hours=DEFAULT_WINDOW_HOURS)
    if not start < end:
        raise ValueError("from must be before to")
    return start, end


def day_window(first: dt.datetime, last: dt.datetime):
    """The window that shows one active day: its first fix up to a second past its last."""
    return first, last + dt.timedelta(seconds=1)


def _moment(name, value):
    if value is None or isinstance(value, dt.datetime):
        return value
    try:
        parsed = dt.datetime.fromisoformat(value)
    except ValueError:
        parsed = None
    if parsed is None or parsed.tzinfo is None:
        raise ValueError(f"{name} must be an RFC 3339 timestamp")
    return parsed.astimezone(dt.timezone.utc)
