"""Jobs for spark-submit: python -m quotemill.jobs JOB --data DIR --out DIR [options]."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quotemill.operators import bars as B
from quotemill.operators import performance as P
from quotemill.operators.checks import Settings
from quotemill.operators.sentiment import event_clusters, ticker_signals
from quotemill.plans import articles, market
from quotemill.session import ship


def indicators(spark: SparkSession, a: Settings) -> None:
    """Moving averages, RSI and ADX of all daily bars, by ticker."""
    c = market.closes(spark, a.data)
    out = B.moving_averages(c).join(B.rsi(c, a.period), ["ticker", "timestamp"], "left").join(B.adx(c.filter("high is not null and low is not null"), a.period), ["ticker", "timestamp"], "left")
    out.write.mode("overwrite").partitionBy("ticker").parquet(os.path.join(a.out, "indicators"))


def signals(spark: SparkSession, a: Settings) -> None:
    """Daily signals of all tickers, and the bars they precede."""
    s = articles.daily_sentiment(spark, a.data)
    s.write.mode("overwrite").parquet(os.path.join(a.out, "signals"))
    articles.asof_tolerance(spark, a.data).write.mode("overwrite").parquet(os.path.join(a.out, "aligned"))


def sentiment(spark: SparkSession, a: Settings) -> None:
    """The articles of the last hours of each asked ticker (of all, if none is named) come to one result for each; prints three of the articles that weigh most."""
    x = articles.scored(spark, a.data).filter("published_at is not null")
    x = x.filter(F.col("ticker").isin(*a.tickers)) if a.tickers else x
    last = x.groupBy("ticker").agg(F.max("published_at").alias("__last"))
    x = x.join(last, "ticker").filter(F.col("published_at") >= F.col("__last") - F.make_interval(hours=F.lit(a.lookback_hours)))
    clustered = event_clusters(x, within=("ticker",))
    result = ticker_signals(clustered, by=("ticker", "__last"), reference=F.col("__last")).withColumnRenamed("__last", "as_of")
    result.write.mode("overwrite").json(os.path.join(a.out, "sentiment"))
    top = clustered.select("ticker", "published_at", "sentiment", "conviction", "headline").orderBy(F.desc("conviction"), F.desc("published_at"), "headline").limit(3)
    for r in top.collect():
        print(f"{r.ticker} {r.published_at:%Y-%m-%d %H:%M} {r.sentiment} {r.conviction:.1f} {r.headline}")


def report(spark: SparkSession, a: Settings) -> None:
    """Measures of every asked ticker over its last months against a benchmark, as CSV, and as sentences."""
    c = market.closes(spark, a.data)
    c = c.filter(F.col("ticker").isin(*a.tickers, a.benchmark)) if a.tickers else c
    last = c.groupBy("ticker").agg(F.max("timestamp").alias("__last"))
    c = c.join(last, "ticker").filter(F.col("timestamp") >= F.add_months("__last", -a.months)).drop("__last")
    s = P.summary(P.curve(c))
    bench = s.filter(F.col("ticker") == a.benchmark).select(F.col("total_return").alias("benchmark_return"), F.lit(1).alias("k"))
    s.withColumn("k", F.lit(1)).join(F.broadcast(bench), "k", "left").drop("k").orderBy("ticker").write.mode("overwrite").option("header", True).csv(os.path.join(a.out, "report"))


JOBS = {f.__name__: f for f in (indicators, signals, sentiment, report)}


def main(argv: list[str] | None = None) -> None:
    """Options outweigh the environment (QUOTEMILL_DATA, QUOTEMILL_TICKERS and so on), and that the defaults."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("--data")
    p.add_argument("--out")
    p.add_argument("--tickers", type=lambda x: tuple(t.strip().upper() for t in x.split(",") if t.strip()))
    p.add_argument("--benchmark")
    for name in ("period", "months", "lookback-hours"):
        p.add_argument(f"--{name}", type=int)
    given = vars(p.parse_args(argv))
    job = given.pop("job")
    a = Settings.from_environment(**given)
    if wrong := a.problems():
        p.error("not usable: " + ", ".join(wrong))
    spark = SparkSession.builder.appName(f"quotemill-{job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    JOBS[job](spark, a)


if __name__ == "__main__":
    main()
