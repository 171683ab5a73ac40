"""Cleaning, resampling and indicators of price bars."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.columns import entity_key, finite
from quotemill.functions.time import frame_start
from quotemill.session import ship

#: Names under which the columns of a bar arrive.
ALIASES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "t": "timestamp", "date": "timestamp", "datetime": "timestamp", "symbol": "ticker", "vw": "vwap", "n": "trade_count", "adj close": "adj_close"}
PRICES = ("open", "high", "low", "close")
REQUIRED = ("ticker", "timestamp", "open", "high", "low", "close", "volume")


def standard_names(df: DataFrame) -> DataFrame:
    """Column names trimmed, in lower case and under their usual names; of two that meet in one name the first stays."""
    names: dict[str, str] = {}
    for c in df.columns:
        n = ALIASES.get(c.strip().lower(), c.strip().lower())
        names.setdefault(n, c)
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()])


def check_bars(df: DataFrame) -> list[str]:
    """What keeps df from being a table of bars; empty if nothing does. Reads one row at most."""
    wrong = [f"no column {c}" for c in REQUIRED if c not in df.columns]
    kinds = dict(df.dtypes)
    wrong += [f"{c} is {kinds[c]}, not a number" for c in (*PRICES, "volume") if c in kinds and kinds[c] not in ("double", "float", "int", "bigint")]
    if kinds.get("timestamp", "timestamp") != "timestamp":
        wrong.append(f"timestamp is {kinds['timestamp']}")
    return wrong or (["no rows"] if df.isEmpty() else [])


def clean_bars(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Bars with standard names and types, without those that have no price at all; of several for one ticker and time the first by `order` stays. Null tickers and times are dropped."""
    df = standard_names(df)
    df = df.withColumns({c: finite(F.col(c).try_cast("double")) for c in (*PRICES, "volume") if c in df.columns}).withColumn("ticker", entity_key(F.col("ticker")))
    df = df.filter("ticker is not null and timestamp is not null").na.drop(how="all", subset=list(PRICES))
    first = Window.partitionBy("ticker", "timestamp").orderBy(*[F.col(c).asc_nulls_last() for c in (order or [c for c in df.columns if c not in ("ticker", "timestamp")])])
    return df.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def by_source(df: DataFrame, keys: Sequence[str], fallback: Column) -> DataFrame:
    """Rows of the primary source; those of the fallback only for keys without any primary row."""
    primary = df.filter(~fallback)
    return primary.unionByName(df.filter(fallback).join(primary.select(*keys).distinct(), list(keys), "left_anti"))


def resample(df: DataFrame, timeframe: str, *, order: Column | None = None) -> DataFrame:
    """ticker, bar_start, open, high, low, close, volume, n: bars of a longer length. Open and close are of the first and last bar with one; one pass with partial aggregation."""
    order = F.col("timestamp") if order is None else order
    return df.groupBy("ticker", frame_start(F.col("timestamp"), timeframe).alias("bar_start")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), order)).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), order)).alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("n"),
    )


def _series(order: str = "timestamp"):
    return Window.partitionBy("ticker").orderBy(order)


def moving_averages(df: DataFrame, windows: Sequence[int] = (20, 50, 200), column: str = "close") -> DataFrame:
    """Means over the last w bars, or as many as there are."""
    return df.withColumns({f"sma_{w}": F.avg(column).over(_series().rowsBetween(1 - w, 0)) for w in windows})


def returns(column: str = "close", order: str = "timestamp") -> Column:
    prev = F.lag(column).over(_series(order))
    return F.when(prev > 0, F.col(column) / prev - 1)


def true_range(order: str = "timestamp") -> Column:
    before = F.lag("close").over(_series(order))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def directional_moves(order: str = "timestamp") -> tuple[Column, Column]:
    up = F.col("high") - F.lag("high").over(_series(order))
    down = F.lag("low").over(_series(order)) - F.col("low")
    return F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0)


def momentum(n: int = 5, order: str = "timestamp") -> Column:
    base = F.coalesce(F.lag("close", n).over(_series(order)), F.first("close").over(_series(order).rowsBetween(Window.unboundedPreceding, 0)))
    return F.when(base != 0, F.col("close") / base - 1)


def smoothed(df: DataFrame, columns: dict[str, tuple[str, float, int]], *, by: Sequence[str] = ("ticker",), order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """df with exponentially weighted means: out -> (column, alpha, values needed before the first one).

    y(0) = x(0), y = alpha x + (1 - alpha) y; over a null the last mean is carried and its
    weight decays. Each series is read in order, a batch at a time; from one batch to the
    next only the last mean of each column is kept, so no series has to fit in memory.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, states = None, {}
        for pdf in batches:
            if pdf.empty:
                continue
            group = pdf.groupby(list(by), sort=False, dropna=False).ngroup().to_numpy()
            cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            keys = [tuple(None if pd.isna(v) else v for v in pdf[list(by)].iloc[a]) for a in cuts]
            values = {c: pdf[c].to_numpy(dtype=float, na_value=np.nan) for c, _, _ in columns.values()}
            means = {out: np.empty(len(pdf)) for out in columns}
            for key, a, b in zip(keys, cuts, np.append(cuts[1:], len(pdf))):
                if key != now:
                    now, states = key, {out: _Mean(alpha, least) for out, (_, alpha, least) in columns.items()}
                for out, (c, _, _) in columns.items():
                    means[out][a:b] = states[out].over(values[c][a:b])
            yield pdf.assign(**means)

    kept = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + "".join(f", `{c}` double" for c in columns)
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, kept)


class _Mean:
    """An exponentially weighted mean that goes on from one piece of a series to the next."""

    def __init__(self, alpha: float, least: int):
        self.alpha, self.least = alpha, least
        self.last, self.gap, self.seen = np.nan, 0, 0

    def over(self, x: np.ndarray) -> np.ndarray:
        # The last mean stands for all before it, followed by the nulls since; beyond some number of them it weighs nothing.
        before = [] if np.isnan(self.last) else [self.last] + [np.nan] * min(self.gap, int(800 / self.alpha))
        y = pd.Series(np.concatenate([before, x])).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[len(before) :].copy()
        there = ~np.isnan(x)
        seen = self.seen + np.cumsum(there)
        if there.any():
            at = int(np.flatnonzero(there)[-1])
            self.last, self.gap, self.seen = y[at], len(x) - 1 - at, int(seen[-1])
        else:
            self.gap += len(x)
        y[seen < self.least] = np.nan
        return y


def rsi(df: DataFrame, period: int = 14) -> DataFrame:
    """ticker, timestamp, rsi: null until `period` changes are known and where there was no loss."""
    moved = df.select("ticker", "timestamp", (F.col("close") - F.lag("close").over(_series())).alias("d")).select("ticker", "timestamp", F.greatest("d", F.lit(0.0)).alias("gain"), F.greatest(-F.col("d"), F.lit(0.0)).alias("loss"))
    moved = moved.withColumns({c: F.when(F.row_number().over(_series()) > 1, F.col(c)) for c in ("gain", "loss")})
    s = smoothed(moved, {"g": ("gain", 1 / period, period), "l": ("loss", 1 / period, period)})
    return s.select("ticker", "timestamp", F.when(F.col("l") > 0, 100 - 100 / (1 + F.col("g") / F.col("l"))).alias("rsi"))


def adx(df: DataFrame, period: int = 14) -> DataFrame:
    """ticker, timestamp, plus_di, minus_di, adx."""
    plus, minus = directional_moves()
    base = df.select("ticker", "timestamp", true_range().alias("tr"), plus.alias("plus"), minus.alias("minus"))
    a = 1 / period
    s = smoothed(base, {"atr": ("tr", a, period), "p": ("plus", a, period), "m": ("minus", a, period)})
    p, m = 100 * F.col("p") / F.nullif(F.col("atr"), F.lit(0.0)), 100 * F.col("m") / F.nullif(F.col("atr"), F.lit(0.0))
    s = s.select("ticker", "timestamp", p.alias("plus_di"), m.alias("minus_di"), (100 * F.abs(p - m) / F.nullif(p + m, F.lit(0.0))).alias("dx"))
    return smoothed(s, {"adx": ("dx", a, period)}).select("ticker", "timestamp", "plus_di", "minus_di", "adx")
