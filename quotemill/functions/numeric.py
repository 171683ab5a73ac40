"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(c: Column, default: float | None = None) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default).cast("double"))


def safe_long(c: Column, default: int | None = None) -> Column:
    """Whole part of a number, through double so that '3.7' is 3."""
    return F.coalesce(F.floor(F.abs(c.try_cast("double"))).cast("long") * F.signum(c.try_cast("double")).cast("long"), F.lit(default).cast("long"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def direction(label: Column) -> Column:
    x = F.upper(F.trim(label))
    return F.when(x == "POSITIVE", 1).when(x == "NEGATIVE", -1).otherwise(0)


def label_of(score: Column, threshold: float) -> Column:
    return F.when(score > threshold, "POSITIVE").when(score < -threshold, "NEGATIVE").otherwise("NEUTRAL")


def jitter(seed: int, *cols: Column) -> Column:
    """A reproducible number in [0, 1) for each combination of values."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / F.lit(float(1 << 53))
