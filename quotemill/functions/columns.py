"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def blank_to_null(c: Column) -> Column:
    """Null where c is null, empty or only white space."""
    return F.when(c.rlike(r"(?U)\S"), c)


def entity_key(c: Column) -> Column:
    """Tickers are compared trimmed and in upper case; blank ones are null."""
    return blank_to_null(F.upper(F.trim(c)))


def finite(c: Column) -> Column:
    """c, with NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def floor_div(c: Column, n: int) -> Column:
    """Whole-number division of a long that rounds down, below zero too."""
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n)).cast("long")


def utc_day(ts: Column) -> Column:
    """The UTC date of an instant, whatever the session's time zone."""
    return F.date_from_unix_date(floor_div(F.unix_micros(ts), DAY_US).cast("int"))


def exact(c: Column, scale: int = 6) -> Column:
    """A double as decimal, so that sums don't depend on their order; null from 1e24 up."""
    return finite(c).try_cast(f"decimal(30,{scale})")
