"""Time expressions; all instants are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bar lengths and the calendar unit or number of minutes each stands for.
TIMEFRAMES = {"1Min": 1, "5Min": 5, "15Min": 15, "30Min": 30, "1Hour": 60, "4Hour": 240, "1Day": 1440, "1Week": "week", "1Month": "month"}
FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def to_utc(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A text as instant by the first format that fits, or as epoch seconds; null if none does."""
    return F.coalesce(F.when(c.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_micros((c.try_cast("decimal(20,6)") * 1_000_000).cast("long"))), *[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def local_time(c: Column, zone: str = "America/New_York") -> Column:
    return F.from_utc_timestamp(c, zone)


def frame_start(ts: Column, timeframe: str) -> Column:
    """Start of the bar of the given length that ts falls in; weeks start on Monday."""
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {timeframe!r}; known are {', '.join(TIMEFRAMES)}")
    unit = TIMEFRAMES[timeframe]
    if isinstance(unit, str):
        return F.date_trunc(unit, ts)
    us = unit * 60_000_000
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(us)))


def within(ts: Column, start: Column, end: Column) -> Column:
    """Closed window; a null time is kept."""
    return ts.isNull() | ts.between(start, end)


def month_chunks(start: Column, end: Column) -> Column:
    """Array of (chunk_start, chunk_end): [start, end) cut at the firsts of months."""
    firsts = F.sequence(F.date_trunc("month", start), end, F.expr("interval 1 month"))
    cut = F.transform(firsts, lambda m: F.struct(F.greatest(m, start).alias("chunk_start"), F.least(F.add_months(m, 1).cast("timestamp"), end).alias("chunk_end")))
    return F.filter(cut, lambda x: x["chunk_start"] < x["chunk_end"])
