"""Why a batch, a reading or a stop report is refused: the first failing rule, or NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.config import (
    MAX_READINGS_PER_BATCH,
    MAX_SKEW_AHEAD_HOURS,
    MAX_STOPS_PER_BATCH,
    MOTION_STATES,
)
from wayfold.functions.predicates import at

# The id that stands for none, and how the skew limit is written in a reason.
NIL_ID = "00000000-0000-0000-0000-000000000000"
SKEW_TEXT = f"{MAX_SKEW_AHEAD_HOURS}h0m0s"


def _missing(value):
    return value.isNull() | value.isin("", NIL_ID)


def _ahead(value, now):
    return value > at(now) + F.expr(f"INTERVAL {MAX_SKEW_AHEAD_HOURS} HOURS")


def _text(number):
    """A number as short as it can be, with an exponent from 1e+06 on and below 1e-04."""
    number = F.col(number) if isinstance(number, str) else number
    value = number.cast("double")
    power = F.floor(F.log10(F.abs(value))).cast("double").try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.abs(number).cast("string"), r"E.*$", ""), r"[.]", "")
    digits = F.regexp_replace(F.regexp_replace(digits, r"^0+", ""), r"0+$", "")
    fraction = F.substring(digits, 2, 20)
    size = F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0"))
    scientific = F.concat(
        F.when(value < 0, "-").otherwise(""), F.substring(digits, 1, 1),
        F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""),
        F.when(power < 0, "e-").otherwise("e+"), size,
    )
    plain = F.when(F.abs(value) < 0.001, F.regexp_replace(F.format_string("%.20f", value), r"\.?0+$", ""))
    plain = F.coalesce(plain, F.regexp_replace(number.cast("string"), r"\.0$", ""))
    return F.when((value != 0) & ((power >= 6) | (power < -4)), scientific).otherwise(plain)


def _infinite(value):
    return F.isnan(value) | (F.abs(value) == float("inf"))


def _reason(*rules, told: bool = True) -> Column:
    """First rule that holds, in order; a NULL condition does not hold. Not told, every text is the same short one."""
    out = None
    if not told:
        rules = [(holds, "refused") for holds, _ in rules]
    for holds, text in rules:
        text = text if isinstance(text, Column) else F.lit(text)
        out = F.when(holds, text) if out is None else out.when(holds, text)
    return out.otherwise(F.lit(None).cast("string"))


def _range(value, low, high):
    """Outside [low, high]. NaN is not: Spark orders NaN above every number."""
    return ~F.isnan(value) & ((value < low) | (value > high))


def _says(name, value, tail):
    return F.concat(F.lit(f"{name} "), _text(value), F.lit(tail))


def batch_reason() -> Column:
    readings = F.coalesce(F.size("readings"), F.lit(0))
    stops = F.coalesce(F.size("stop_events"), F.lit(0))
    readings, stops = F.greatest(readings, F.lit(0)), F.greatest(stops, F.lit(0))
    return _reason(
        (F.col("device_id").isNull() | (F.col("device_id") == ""), "device_id is required"),
        ((readings == 0) & (stops == 0), "batch must contain readings or stop_events"),
        (
            readings > MAX_READINGS_PER_BATCH,
            F.format_string(f"batch has %d readings, limit is {MAX_READINGS_PER_BATCH}", readings),
        ),
        (
            stops > MAX_STOPS_PER_BATCH,
            F.format_string(f"batch has %d stop_events, limit is {MAX_STOPS_PER_BATCH}", stops),
        ),
    )


def reading_reason(now, of=F.col, told: bool = True) -> Column:
    """Rules for one reading, whose fields `of` gives. Lateness is never a reason; being over 24 hours ahead is."""
    bad_number = " must be a finite non-negative number"
    return _reason(
        (_missing(of("reading_id")), "reading_id is required"),
        (of("recorded_at").isNull(), "recorded_at is required"),
        (_ahead(of("recorded_at"), now), f"recorded_at is more than {SKEW_TEXT} in the future"),
        (_range(of("lat"), -90, 90), _says("lat", of("lat"), " out of range [-90, 90]")),
        (_range(of("lon"), -180, 180), _says("lon", of("lon"), " out of range [-180, 180]")),
        (F.isnan(of("lat")) | F.isnan(of("lon")), "lat/lon must be finite numbers"),
        ((of("speed_mps") < 0) | _infinite(of("speed_mps")), _says("speed_mps", of("speed_mps"), bad_number)),
        (
            _range(of("heading_deg"), 0, 360) | _infinite(of("heading_deg")),
            _says("heading_deg", of("heading_deg"), " out of range [0, 360]"),
        ),
        ((of("accuracy_m") < 0) | _infinite(of("accuracy_m")), _says("accuracy_m", of("accuracy_m"), bad_number)),
        (
            (of("battery_pct") < 0) | (of("battery_pct") > 100),
            _says("battery_pct", of("battery_pct"), " out of range [0, 100]"),
        ),
        (
            ~of("motion_state").isin(*MOTION_STATES),
            F.format_string('motion_state "%s" is not recognised', of("motion_state")),
        ),
        told=told,
    )


def stop_reason(now, of=F.col, told: bool = True) -> Column:
    """Rules for one device-reported stop, whose fields `of` gives."""
    return _reason(
        (_missing(of("event_id")), "event_id is required"),
        (of("arrived_at").isNull(), "arrived_at is required"),
        (_ahead(of("arrived_at"), now), f"arrived_at is more than {SKEW_TEXT} in the future"),
        (of("departed_at") < of("arrived_at"), "departed_at is before arrived_at"),
        (_ahead(of("departed_at"), now), f"departed_at is more than {SKEW_TEXT} in the future"),
        (
            _range(of("lat"), -90, 90) | F.isnan(of("lat")),
            _says("lat", of("lat"), " out of range [-90, 90]"),
        ),
        (
            _range(of("lon"), -180, 180) | F.isnan(of("lon")),
            _says("lon", of("lon"), " out of range [-180, 180]"),
        ),
        told=told,
    )


def accepted_rows(df, rule, now):
    """Rows that no rule of reading_reason or stop_reason refuses; only asks whether one holds."""
    return df.filter(rule(now, told=False).isNull())


def split_valid(df, rule, now, id_column: str):
    """(accepted rows, rejected (id, reason) rows) by reading_reason or stop_reason; one bad row never costs the others.

    The accepted side asks only whether a rule holds: with the texts, its code would be too long to compile.
    The rejected side explodes the reason, if any, instead of filtering on it: Spark would otherwise
    evaluate the whole rule chain twice per row, in a method too long for the JIT compiler.
    """
    accepted = accepted_rows(df, rule, now)
    found = F.explode(F.array_compact(F.array(rule(now)))).alias("reason")
    return accepted, df.select(F.coalesce(F.col(id_column), F.lit(NIL_ID)).alias("id"), found)
