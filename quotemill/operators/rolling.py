"""Trailing totals by differences of prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.columns import entity_key, exact, utc_day


def trailing_totals(df: DataFrame, *, entity: str = "ticker", at: str = "timestamp", values: Sequence[str] = ("volume", "close"), windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and averages over trailing calendar days, for every entity and day from its first row to its last.

    Columns: entity, trade_day (date), day_no (the first day is 1), and for each value v
    and window n: total_v_n, avg_v_n (days without a row count as 0; divided by n),
    seen_v_n (days in the window with a value) and mean_v_n (total / rows that have a
    value; null without one).

    Rows are first added up by entity and day (combined before the shuffle, so a busy
    entity costs no more than its days). The prefix sums of an entity run over those
    days, are filled forward over days without a row, and a trailing total is the
    difference of two of them. Sums are exact decimals (6 places, below 1e24), so a huge
    value leaves no rounding behind in later windows.

    Null, NaN, infinite or larger values count as 0. Rows whose entity or time is null
    belong to no series and are left out. Windows that start before the first day cover
    the days there are. An empty input gives no rows. Extra columns are ignored.
    """
    rows = df.select(entity_key(F.col(entity)).alias("__e"), utc_day(F.col(at)).alias("__d"), *[exact(F.col(v)).alias(f"__v{i}") for i, v in enumerate(values)])
    daily = (
        rows.filter("__e is not null and __d is not null")
        .groupBy("__e", "__d")
        .agg(*[x for i in range(len(values)) for x in (F.coalesce(F.sum(f"__v{i}"), F.lit(0).cast("decimal(38,6)")).alias(f"__v{i}"), F.count(f"__v{i}").alias(f"__n{i}"))])
    )
    by_day = Window.partitionBy("__e").orderBy("__d")
    upto = by_day.rowsBetween(Window.unboundedPreceding, 0)
    days = F.col("__n0") * 0 + 1
    prefix = daily.select(
        "__e",
        "__d",
        F.lead("__d").over(by_day).alias("__next"),
        F.min("__d").over(upto).alias("__first"),
        *[x for i in range(len(values)) for x in (F.sum(f"__v{i}").over(upto).alias(f"__p{i}"), F.sum(f"__n{i}").over(upto).alias(f"__c{i}"), F.sum(F.when(F.col(f"__n{i}") > 0, days).otherwise(0)).over(upto).alias(f"__s{i}"))],
    )
    filled = prefix.withColumn("__d", F.explode(F.sequence("__d", F.coalesce(F.date_sub("__next", 1), F.col("__d"))))).drop("__next")

    def back(c: str, n: int):
        return F.col(c) - F.coalesce(F.lag(c, n).over(by_day), F.lit(0))

    out = [F.col("__e").alias(entity), F.col("__d").alias("trade_day"), (F.datediff("__d", "__first") + 1).alias("day_no")]
    for i, v in enumerate(values):
        for n in windows:
            out += [back(f"__p{i}", n).cast("decimal(38,6)").alias(f"total_{v}_{n}"), back(f"__c{i}", n).alias(f"__rows_{v}_{n}"), back(f"__s{i}", n).alias(f"seen_{v}_{n}")]
    wide = filled.select(*out)
    final = [F.col(entity), F.col("trade_day"), F.col("day_no")]
    for v in values:
        for n in windows:
            total = F.col(f"total_{v}_{n}")
            final += [total, (total.cast("double") / n).alias(f"avg_{v}_{n}"), F.col(f"seen_{v}_{n}"), (total.cast("double") / F.nullif(F.col(f"__rows_{v}_{n}"), F.lit(0))).alias(f"mean_{v}_{n}")]
    return wide.select(*final)


def busier_than_usual(totals: DataFrame, *, entity: str = "ticker", value: str = "volume", short: int = 7, long: int = 30, num: int = 3, den: int = 2) -> DataFrame:
    """Days from day `long` on whose short average exceeds num/den times the long one, compared without division."""
    s, t = F.col(f"total_{value}_{short}"), F.col(f"total_{value}_{long}")
    return totals.filter((F.col("day_no") >= long) & (s * (long * den) > t * (short * num))).select(entity, F.date_format("trade_day", "yyyy-MM-dd").alias("trade_day"))
