"""Thresholds and limits. Every operator takes them as an argument; these are the defaults."""

from dataclasses import dataclass

# Limits and defaults the results depend on.
MAX_READINGS_PER_BATCH = 1000
MAX_STOPS_PER_BATCH = 200
MAX_SKEW_AHEAD_HOURS = 24
MAX_POSITIONS_PER_PAGE = 5000
MAX_ACTIVE_DAYS = 365
DEFAULT_WINDOW_HOURS = 24
LOCAL_HISTORY_LIMIT = 5000
LOCAL_RETENTION_DAYS = 7
MAX_ATTEMPTS = 5
MAX_QUEUE_SIZE = 50_000
DEAD_ITEMS_LIMIT = 20
MOTION_STATES = ("still", "walking", "driving", "unknown")
SOURCES = ("client", "derived")
TIER_PROFILES = {  # tier: (time interval ms, distance interval m)
    "active": (10_000, 20),
    "idle": (60_000, 50),
    "saver": (180_000, 100),
}
FALLBACK_CAMERA = (49.2827, -123.1207, 11)


@dataclass(frozen=True)
class DetectConfig:
    """Server-side derivation and reconciliation thresholds."""

    stop_radius_m: float = 50.0
    stop_min_seconds: float = 120.0
    trip_gap_seconds: float = 600.0
    match_max_seconds: float = 120.0
    match_max_m: float = 100.0


@dataclass(frozen=True)
class ClientConfig:
    """On-device stop detector thresholds."""

    still_speed_mps: float = 1.0
    radius_m: float = 50.0
    min_dwell_seconds: float = 90.0
    max_accuracy_m: float = 50.0


@dataclass(frozen=True)
class SamplingConfig:
    """Sampling-tier policy."""

    low_battery_pct: int = 20
    min_tier_seconds: float = 120.0


@dataclass(frozen=True)
class DrainConfig:
    """Battery drain report: lower bound of each fixes-per-hour band, and the longest usable gap."""

    band_starts: tuple = (20, 60, 120)
    max_gap_seconds: float = 1800.0
