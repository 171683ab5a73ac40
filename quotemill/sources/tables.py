"""Tables kept between runs: bars, articles, scores, and what was decided."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.sources.feeds import BARS, NEWS


def write_bars(df: DataFrame, path: str) -> None:
    """By ticker, so that a scan of some tickers reads only their folders."""
    df.repartition("ticker").write.mode("overwrite").partitionBy("ticker").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BARS).parquet(path)


def write_articles(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines by schema, so that times are times again."""
    return spark.read.schema(NEWS).json(path)


def append_scores(df: DataFrame, path: str, batch: int, ttl: float | None = None, now: Column | None = None) -> None:
    """Scores keyed by content_hash; a later batch replaces earlier ones when read. With ttl they expire so many seconds from now, else never."""
    at = F.current_timestamp() if now is None else now
    expires = F.lit(None).cast("timestamp") if ttl is None else at + F.make_dt_interval(secs=F.lit(ttl).cast("decimal(18,6)"))
    df.withColumns({"batch": F.lit(batch), "expires_at": expires}).write.mode("append").parquet(path)


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def unexpired(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows whose expires_at is null or not past; all of them where there is no such column."""
    if "expires_at" not in df.columns:
        return df
    return df.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= (F.current_timestamp() if now is None else now)))


def read_scores(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """The last score of every key, unless it has expired: an expired one doesn't bring back those it replaced."""
    return unexpired(latest_by(spark.read.option("mergeSchema", True).parquet(path), "content_hash", "batch"), now)


def evict_expired(spark: SparkSession, path: str, to: str, now: Column | None = None) -> None:
    """Writes what read_scores gives to another folder, without the rows that were replaced or have expired."""
    read_scores(spark, path, now).write.mode("overwrite").parquet(to)


def two_tier(wanted: DataFrame, memory: DataFrame, disk: DataFrame, *, key: str, ttl_seconds: int, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(found, memory): what two tiers hold of the wanted keys, with tier ('memory', 'disk' or 'none'), and the short-lived tier afterwards.

    memory has key, value and expires_at, of which stale rows count as absent; disk has key and
    value and never expires. What only the disk holds enters memory again for half the
    usual time; what has expired is evicted. Keys are unique in each tier; null keys are
    found nowhere.
    """
    at = F.current_timestamp() if now is None else now
    live = unexpired(memory, at)
    kept = F.make_dt_interval(secs=F.lit(ttl_seconds / 2).cast("decimal(18,6)"))
    m = live.select(key, F.col("value").alias("__m"), F.lit(True).alias("__in_m"))
    x = wanted.select(key).distinct().join(m, key, "left").join(disk.select(key, F.col("value").alias("__d"), F.lit(True).alias("__in_d")), key, "left")
    tier = F.when(F.col("__in_m"), "memory").when(F.col("__in_d"), "disk").otherwise("none")
    found = x.select(key, F.coalesce("__m", "__d").alias("value"), tier.alias("tier"))
    promoted = found.filter("tier = 'disk'").select(key, "value", (at + kept).alias("expires_at"))
    return found, live.select(key, "value", "expires_at").unionByName(promoted)


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df without the rows of some keys."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def scored_and_new(items: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items whose content was scored before, with the score, and those that weren't."""
    return items.join(scores, "content_hash"), items.join(scores.select("content_hash"), "content_hash", "left_anti")


def append_log(df: DataFrame, path: str, category: str, ticker: str = "ticker", at: str = "timestamp") -> None:
    """One JSON line per row, the row itself as nested payload, in a folder per category."""
    rest = [c for c in df.columns if c not in (ticker, at)]
    df.select(F.lit(category).alias("category"), F.col(ticker).alias("ticker"), F.col(at).alias("timestamp"), F.to_json(F.struct(*rest)).alias("data")).write.mode("append").partitionBy("category").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def drop_table(path: str) -> None:
    """Removes a table of these, wherever it lies."""
    spark = SparkSession.getActiveSession()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table_path(root: str, *parts: str) -> str:
    return os.path.join(root, *[x.translate(str.maketrans("/: ", "___")) for x in parts])
