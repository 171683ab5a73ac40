"""Windows over event streams; each function takes a streaming or a batch DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quotemill.session import ship


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(df: DataFrame, *, at: str = "ts", by: str = "event_type", value: str = "value", length: str = "1 day", late: str = "1 hour") -> DataFrame:
    x = df.withWatermark(at, late) if df.isStreaming else df
    return x.groupBy(F.window(at, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(20,4)")).cast("double").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sliding(df: DataFrame, *, at: str = "ts", by: str = "event_type", value: str = "value", length: str = "24 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    x = df.withWatermark(at, late) if df.isStreaming else df
    return x.groupBy(F.window(at, length, step).alias("w"), by).agg(F.count("*").alias("n"), F.max(value).alias("top")).select(F.col("w.start").alias("window_start"), by, "n", "top")


def sessions(df: DataFrame, *, at: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    x = df.withWatermark(at, late) if df.isStreaming else df
    return x.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def not_late(df: DataFrame, *, at: str, received: str, hours: float) -> DataFrame:
    """Rows received at most so long after their time; rows without a time are kept."""
    age = (F.unix_micros(F.col(received)) - F.unix_micros(F.col(at))) / F.lit(3.6e9)
    return df.filter(F.col(at).isNull() | (age <= hours))


def first_seen(df: DataFrame, *, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Rows whose keys were not seen within the watermark before."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def running_last(df: DataFrame, *, by: str = "event_type", at: str = "ts", value: str = "value") -> DataFrame:
    """Streams only: after each batch the count, the latest time and its value of every key that had rows in it, kept in keyed state."""
    ship(df.sparkSession)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, v = state.get if state.exists else (0, None, None)
        for p in parts:
            n += len(p)
            timed = p[p[at].notna()]
            if timed.empty:
                continue
            top = timed.loc[timed[at].idxmax()]
            t = int(top[at].value // 1000)
            if last is None or t > last:
                last, v = t, float(top[value])
        state.update((n, last, v))
        yield pd.DataFrame({by: [key[0]], "n": [n], "last_us": [last], "last_value": [v]})

    kind = dict(df.dtypes)[by]
    return df.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, n long, last_us long, last_value double", "n long, last_us long, last_value double", "update", GroupStateTimeout.NoTimeout)
