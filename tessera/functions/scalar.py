"""Scalar column functions of the feature projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SCALE, SENTINEL


def f32(x: Column | float) -> Column:
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("float")


def clamp01(x: Column) -> Column:
    return F.greatest(f32(0.0), F.least(f32(1.0), f32(x)))


def scaled(x: Column, top: float) -> Column:
    """``x / top`` in single precision, clamped to [0, 1]."""
    return clamp01(f32(f32(x) / f32(top)))


def guarded_ratio(a: Column, b: Column, top: float) -> Column:
    """Clamped ``a / b / top`` where ``b`` is positive, else 0."""
    return F.when(b > 0, clamp01(f32(f32(f32(a) / f32(b)) / f32(top)))).otherwise(f32(0.0))


def flag(x: Column) -> Column:
    """1 for true, else 0; null is false."""
    return F.coalesce(x, F.lit(False)).cast("float")


def quantize(x: Column) -> Column:
    """Integer code of a feature: the sentinel for missing values, else 0..SCALE,
    rounded half away from zero in single precision."""
    return F.when(x <= -0.5, F.lit(SENTINEL)).otherwise(F.round(clamp01(x) * f32(float(SCALE))).cast("int"))


def tag(high: Column, low: Column) -> Column:
    """Partition of a vector: two bits, one from each of two quantized dimensions."""
    return F.when(high > 0, 2).otherwise(0) + F.when(low >= 0, 1).otherwise(0)


def risk_code(mcc: Column) -> Column:
    """The four leading characters of a category code, digits only."""
    return F.regexp_replace(F.substring(mcc, 1, 4), "[^0-9]", "")


def bounded_int(text: Column, default: int, low: int, high: int) -> Column:
    """``config.bounded_int`` of a column: the number that a text begins with, clamped."""
    n = F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0))
    return F.when(text.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), n))).cast("int")
