"""Device readings to stored values, and the labels shown for them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.config import TIER_PROFILES, SamplingConfig


def _col(c):
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def normalise_heading(heading) -> Column:
    """Degrees in [0, 360); NULL when missing or negative."""
    h = _col(heading)
    return F.when(h >= 0, h % 360)


def motion_from(speed) -> Column:
    s = _col(speed)
    return (
        F.when(s.isNull() | (s < 0), "unknown")
        .when(s < 0.5, "still")
        .when(s < 2.5, "walking")
        .otherwise("driving")
    )


def battery_pct_from(level) -> Column:
    """Percentage from a level in [0, 1]; NULL when missing, not finite or negative."""
    v = _col(level)
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v >= 0)
    pct = F.floor(F.least(F.lit(1.0), v) * 100 + 0.5)
    return F.when(usable, pct).cast("smallint")


def sampling_tier(motion, battery_pct, charging, cfg: SamplingConfig = SamplingConfig()) -> Column:
    """The tier wanted under given conditions."""
    moving = ~F.coalesce(_col(motion) == "still", F.lit(False))
    return (
        F.when(_col(charging) | moving, "active")
        .when(_col(battery_pct) < cfg.low_battery_pct, "saver")
        .otherwise("idle")
    )


def tier_profile(tier) -> Column:
    """struct(time_interval_ms, distance_interval_m) of a tier."""
    t = _col(tier)
    out = None
    for name, (ms, metres) in TIER_PROFILES.items():
        value = F.struct(F.lit(ms).alias("time_interval_ms"), F.lit(metres).alias("distance_interval_m"))
        out = F.when(t == name, value) if out is None else out.when(t == name, value)
    return out


def dwell_label(arrived, departed) -> Column:
    """How long a stop lasted, in words."""
    us = F.unix_micros(_col(departed)) - F.unix_micros(_col(arrived))
    minutes = F.floor(F.floor(us / 1000) / 60000 + 0.5).cast("bigint")
    return (
        F.when(_col(departed).isNull(), "still here")
        .when(_col(arrived).isNull() | (us < 0), "unknown")
        .when(minutes < 1, "<1 min")
        .when(minutes < 60, F.format_string("%d min", minutes))
        .otherwise(F.format_string("%dh %dm", F.floor(minutes / 60).cast("bigint"), minutes % 60))
    )


def route_source(local_count, server_count) -> Column:
    local, server = _col(local_count), _col(server_count)
    return F.when((local > 0) & (server > 0), "both").when(server > 0, "server").otherwise("local")


def source_label(online, source, local_only, server_failed) -> Column:
    """Sync status of a merged route."""
    return (
        F.when(~_col(online), "offline · local only")
        .when(_col(server_failed), "no server · local only")
        .when(_col(source) == "local", "local only")
        .when(_col(local_only) > 0, F.format_string("synced · %d pending", _col(local_only)))
        .otherwise("synced")
    )


def tracking_state(registered, services_enabled, last_fix_at) -> Column:
    return (
        F.when(~_col(registered), "off")
        .when(~_col(services_enabled), "blocked")
        .when(_col(last_fix_at).isNull(), "awaiting-fix")
        .otherwise("running")
    )


def tracking_label(state) -> Column:
    s = _col(state)
    return (
        F.when(s == "off", "stopped")
        .when(s == "blocked", "location off")
        .when(s == "awaiting-fix", "no fix yet")
        .when(s == "running", "running")
    )


def is_healthy(state) -> Column:
    return _col(state) == "running"


def needs_user_action(state) -> Column:
    return _col(state) == "blocked"
