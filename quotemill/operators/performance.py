"""Measures of return series, as aggregates over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.numeric import ratio

YEAR = 252


def curve(df: DataFrame, *, by: str = "ticker", at: str = "timestamp", value: str = "close") -> DataFrame:
    """by, at, value, base (first positive value), growth (value / base), change (to the value before; null for the first), peak and drop (from the highest value so far)."""
    rows = df.filter(F.col(value) > 0).select(by, at, value)
    w = Window.partitionBy(by).orderBy(at)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first, peak = F.first(value).over(upto), F.max(value).over(upto)
    return rows.select(by, at, value, first.alias("base"), (F.col(value) / first).alias("growth"), (F.col(value) / F.lag(value).over(w) - 1).alias("change"), peak.alias("peak"), (F.col(value) / peak - 1).alias("drop"))


def annualised(total: Column, n: Column, year: int = YEAR) -> Column:
    return F.when((n > 0) & (total > -1), F.pow(1 + total, F.lit(float(year)) / n) - 1)


def sharpe(change: Column, year: int = YEAR) -> Column:
    return ratio(F.avg(change), F.stddev_samp(change)) * math.sqrt(year)


def downside(change: Column, year: int = YEAR) -> Column:
    low = F.when(change < 0, change)
    return F.when(F.count(low) >= 2, F.stddev_samp(low)) * math.sqrt(year)


def summary(c: DataFrame, *, by: str = "ticker", at: str = "timestamp", value: str = "close") -> DataFrame:
    """One row per series of curve(): bars, total_return, annual_return, max_drawdown, sharpe, downside, calmar."""
    s = c.groupBy(by).agg(F.count("*").alias("bars"), (F.max_by("growth", at) - 1).alias("total_return"), F.least(F.min("drop"), F.lit(0.0)).alias("max_drawdown"), sharpe(F.col("change")).alias("sharpe"), downside(F.col("change")).alias("downside"))
    a = annualised(F.col("total_return"), F.col("bars") - 1)
    return s.withColumn("annual_return", a).withColumn("calmar", ratio(F.col("annual_return"), F.abs("max_drawdown")))


def gains_and_losses(df: DataFrame, *, by: str, gain: Column) -> DataFrame:
    """n, wins, losses, win_rate, profit_factor (null without a loss), avg_win, avg_loss (zero included), best, worst, total."""
    g = gain
    won, lost = F.when(g > 0, g), F.when(g < 0, g)
    return df.filter(g.isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"),
        F.count(won).alias("wins"),
        F.count(lost).alias("losses"),
        (F.count(won) / F.count("*")).alias("win_rate"),
        ratio(F.coalesce(F.sum(won), F.lit(0.0)), F.abs(F.sum(lost))).alias("profit_factor"),
        F.avg(won).alias("avg_win"),
        F.avg(F.when(g <= 0, g)).alias("avg_loss"),
        F.max(g).alias("best"),
        F.min(g).alias("worst"),
        F.sum(g).alias("total"),
    )


def activity(df: DataFrame, *, by: str = "ticker", at: str = "timestamp") -> DataFrame:
    """Average money volume, yearly volatility in percent (from more than five changes) and the part of bars above their 50-bar mean."""
    w = Window.partitionBy(by).orderBy(at)
    prev = F.lag("close").over(w)
    rows = df.filter(F.col("close") > 0).select(by, at, "close", "volume", F.when(prev > 0, F.col("close") / prev - 1).alias("change"), F.avg("close").over(w.rowsBetween(-49, 0)).alias("sma"))
    return rows.groupBy(by).agg(
        F.count("*").alias("bars"),
        F.avg(F.col("close") * F.col("volume")).alias("money_volume"),
        F.when(F.count("change") > 5, F.stddev_samp("change") * math.sqrt(YEAR) * 100).alias("volatility"),
        F.avg((F.col("close") > F.col("sma")).cast("double")).alias("above_mean"),
    )


def leaders(df: DataFrame, *, every: int = 21, look_back: int = 60, n: int = 4) -> DataFrame:
    """as_of (timestamp), place, ticker, money_volume: at the first trading time and each `every` ones after, the n tickers with the most money volume over their last look_back bars.

    Ranks within a ticker give each bar the span of dates for which it is among the last
    ones, so bars meet their dates in one join on the date's number, not all with all.
    """
    rows = df.filter(F.col("close").isNotNull() & F.col("volume").isNotNull()).select("ticker", "timestamp", (F.col("close") * F.col("volume")).alias("money"))
    dates = rows.select("timestamp").distinct()
    numbered = dates.withColumn("d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("timestamp")) - 1)
    w = Window.partitionBy("ticker").orderBy("timestamp")
    total = rows.join(numbered, "timestamp").select("ticker", "d", F.avg("money").over(w.rowsBetween(1 - look_back, 0)).alias("money_volume"), F.lead("d").over(w).alias("next"))
    last = numbered.agg(F.max("d").alias("last"))
    span = total.crossJoin(F.broadcast(last)).select("ticker", "money_volume", F.explode(F.sequence(F.ceil(F.col("d") / every).cast("int"), F.floor(F.coalesce(F.col("next") - 1, F.col("last")) / every).cast("int"))).alias("k"), "d", "next").filter((F.col("k") * every >= F.col("d")) & (F.col("next").isNull() | (F.col("k") * every < F.col("next"))))
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("money_volume"), "ticker"))
    return span.withColumn("place", place).filter(F.col("place") <= n).join(numbered.select((F.col("d") / every).alias("k"), F.col("timestamp").alias("as_of")).filter("k = floor(k)").select(F.col("k").cast("int"), "as_of"), "k").select("as_of", "place", "ticker", "money_volume")
