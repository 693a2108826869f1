"""Time functions.  Timestamps are ISO-8601 strings; the session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp01, f32


def epoch_seconds(s: Column) -> Column:
    """Seconds since 1970; strings that are short or no timestamp give 0."""
    full = F.when(F.length(s) >= 19, F.try_to_timestamp(s))
    return F.coalesce(F.unix_seconds(full), F.lit(0).cast("bigint"))


def hour_feature(seconds: Column) -> Column:
    return clamp01(f32(F.hour(F.timestamp_seconds(seconds)) / f32(23.0)))


def weekday_feature(seconds: Column) -> Column:
    """Monday is 0."""
    return clamp01(f32(F.weekday(F.timestamp_seconds(seconds)) / f32(6.0)))


def minutes_apart(a: Column, b: Column, top: float) -> Column:
    """Distance in time as a share of ``top`` minutes; the order doesn't matter."""
    return clamp01(f32(F.abs(a - b).cast("double") / 60.0 / top))
