"""Text built from metrics: numbers, durations, embeds and sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def rounded(value: Column) -> Column:
    """Integer text, halves rounded up."""
    return F.floor(value.cast("double") + 0.5).cast("bigint").cast("string")


def compact(value: Column, short_thousands: bool = False) -> Column:
    """``950``, ``1.23k``, ``12.3k``, ``1.50m``; the short variant has one digit for every thousand."""
    magnitude = F.abs(value.cast("double"))
    millions = F.concat(fixed(value / 1_000_000, 2), F.lit("m"))
    tens = F.concat(fixed(value / 1_000, 1), F.lit("k"))
    thousands = tens if short_thousands else F.concat(fixed(value / 1_000, 2), F.lit("k"))
    return (
        F.when(magnitude >= 1_000_000, millions).when(magnitude >= 10_000, tens)
        .when(magnitude >= 1_000, thousands).otherwise(rounded(value))
    )


def duration(ms: Column) -> Column:
    """``m:ss``; negative lengths read 0:00."""
    total = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("bigint")
    return F.format_string("%d:%02d", F.floor(total / 60).cast("bigint"), total % 60)


def percent(value: Column, digits: int = 1) -> Column:
    missing = value.isNull() | F.isnan(value.cast("double"))
    return F.when(missing, F.lit(DASH)).otherwise(F.concat(fixed(value, digits), F.lit("%")))


def clock(ts_ms: Column, zone: str = "America/New_York") -> Column:
    """``HH:mm`` of an epoch instant in a named zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_millis(ts_ms).cast("timestamp_ntz"))
    return F.date_format(local, "HH:mm")


def iso_instant(ts_ms: Column) -> Column:
    """``2026-08-15T22:20:00.000Z`` whatever the session zone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(ts_ms).cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def phase_threshold(trigger: Column) -> Column:
    """Highest percentage named in a trigger text."""
    values = F.regexp_extract_all(trigger, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1))
    return F.array_max(F.transform(values, lambda v: v.cast("double")))


def limits(group_size: Column) -> Column:
    """Default role limits of a group size as (tanks, healers, dps)."""

    def of(tanks: int, healers: int, dps: int) -> Column:
        return F.struct(F.lit(tanks).alias("tanks"), F.lit(healers).alias("healers"), F.lit(dps).alias("dps"))

    return F.when(group_size == 16, of(4, 4, 8)).when(group_size == 4, of(1, 1, 2)).otherwise(of(2, 2, 4))


def open_slots_text(is_full: Column, tanks: Column, healers: Column, dps: Column) -> Column:
    """``Needs 1 tank, 2 dps``, or ``Full``."""
    needed = F.concat_ws(
        ", ",
        F.when(tanks > 0, F.concat(tanks.cast("string"), F.lit(" tank"))),
        F.when(healers > 0, F.concat(healers.cast("string"), F.lit(" heal"))),
        F.when(dps > 0, F.concat(dps.cast("string"), F.lit(" dps"))),
    )
    return F.when(is_full | (needed == ""), "Full").otherwise(F.concat(F.lit("Needs "), needed))


def mode(difficulty: Column, group_size: Column) -> Column:
    """``Veteran · 8-player`` without the parts that are unknown."""
    size = F.when(group_size.isNotNull(), F.concat(group_size.cast("string"), F.lit("-player")))
    return F.concat_ws(" · ", difficulty, size)
