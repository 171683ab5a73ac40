"""Landed responses of market data and news providers, read into common schemas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.columns import blank_to_null, entity_key
from quotemill.functions.text import one_line, strip_tags, title_and_source
from quotemill.functions.time import TIMEFRAMES, to_utc
from quotemill.operators.bars import clean_bars

BARS = "ticker string, timestamp timestamp, open double, high double, low double, close double, volume double, source string, timeframe string, is_fallback boolean, currency string, ingested_at timestamp"
NEWS = "ticker string, headline string, snippet string, source string, published_at timestamp, url string, provider string, author string, language string, related_tickers array<string>, article_id string, ingested_at timestamp"
NEWS_COLUMNS = [c.strip().split(" ")[0] for c in NEWS.split(",")]

PAGED = "id string, headline string, summary string, source string, created_at string, url string, author string, symbols array<string>"
DATED = "symbol string, title string, text string, site string, publishedDate string, url string, author string"
STAMPED = "id long, headline string, summary string, source string, datetime long, url string, related string"
FEED_ITEM = "title string, link string, guid string, description string, pubDate string, published string, updated string, created string"


def _news(df: DataFrame, provider: str, **columns: Column) -> DataFrame:
    kinds = dict(x.strip().split(" ", 1) for x in NEWS.split(","))
    whole = {"provider": F.lit(provider)} | columns
    return df.select(*[whole.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in NEWS_COLUMNS]).filter(blank_to_null(F.col("headline")).isNotNull())


def paged_news(df: DataFrame, provider: str = "alpaca") -> DataFrame:
    """Articles of a paged service: one row per article of PAGED. Several symbols give the first as ticker."""
    return _news(df, provider, ticker=entity_key(F.try_element_at("symbols", F.lit(1))), headline=one_line(F.col("headline")), snippet=F.col("summary"), source=F.col("source"), published_at=to_utc(F.col("created_at")), url=F.col("url"), author=F.col("author"), related_tickers=F.col("symbols"), article_id=F.col("id"))


def dated_news(df: DataFrame, provider: str = "fmp") -> DataFrame:
    """Articles with 'yyyy-MM-dd HH:mm:ss' dates and no id of their own: the url serves as one."""
    return _news(df, provider, ticker=entity_key(F.col("symbol")), headline=one_line(F.col("title")), snippet=F.col("text"), source=F.col("site"), published_at=F.try_to_timestamp("publishedDate", F.lit("yyyy-MM-dd HH:mm:ss")), url=F.col("url"), author=F.col("author"), related_tickers=F.array("symbol"), article_id=F.col("url"))


def stamped_news(df: DataFrame, ticker: Column, provider: str = "finnhub") -> DataFrame:
    """Articles with epoch seconds and comma-separated symbols, the asked ticker standing in for none."""
    related = F.filter(F.split(F.coalesce("related", F.lit("")), ","), lambda x: F.trim(x) != "")
    return _news(df, provider, ticker=ticker, headline=one_line(F.col("headline")), snippet=F.col("summary"), source=F.col("source"), published_at=F.timestamp_seconds("datetime"), url=F.col("url"), related_tickers=F.when(F.size(related) > 0, related).otherwise(F.array(ticker)), article_id=F.col("id").cast("string"))


def feed_items(df: DataFrame, ticker: Column, feed: str, provider: str = "rss", split_source: bool = False) -> DataFrame:
    """Items of an RSS feed; the first date that can be read counts, tags are dropped, 'title - source' is split if asked."""
    title, named = title_and_source(strip_tags(F.col("title"))) if split_source else (strip_tags(F.col("title")), F.lit(None))
    rfc = lambda c: F.coalesce(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.col(c), r"^\w{3},\s*", ""), r"(GMT|UTC|UT|Z)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")), to_utc(F.col(c)))
    return _news(df, provider, ticker=ticker, headline=one_line(title), snippet=one_line(strip_tags(F.col("description"))), source=F.coalesce(named, F.lit(feed)), published_at=F.coalesce(*[rfc(c) for c in ("pubDate", "published", "updated", "created")]), url=F.col("link"), article_id=F.coalesce(blank_to_null(F.col("guid")), F.col("link")))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files."""
    return spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def in_order(sources: Sequence[DataFrame]) -> DataFrame:
    """All rows of the sources, with provider_priority by the place of each in the list."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("provider_priority", F.lit(i)) for i, df in enumerate(sources)])


def supplemented(main: DataFrame, extra: DataFrame, *, by: str = "ticker", least: int = 3) -> DataFrame:
    """main, and the rows of extra for those keys of which main has fewer than `least`."""
    enough = main.groupBy(by).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(by)
    return main.unionByName(extra.join(enough, by, "left_anti"), allowMissingColumns=True)


def quotes(df: DataFrame) -> DataFrame:
    """ticker, last_price, ask_price, bid_price, timestamp: the latest quote of each ticker; the price is the middle of bid and ask."""
    mid = (F.col("ask_price") + F.col("bid_price")) / 2
    last = F.max_by(F.struct(mid.alias("last_price"), "ask_price", "bid_price", "timestamp"), "timestamp")
    return df.groupBy("ticker").agg(last.alias("q")).select("ticker", "q.*")


def last_prices(wanted: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """ticker, last_price, source of every wanted ticker: from the primary prices, else the fallback, else null from 'none'."""
    p, f = primary.select("ticker", F.col("last_price").alias("__p"), F.col("source").alias("__ps")), fallback.select("ticker", F.col("last_price").alias("__f"), F.col("source").alias("__fs"))
    have = F.when(F.col("__p").isNotNull(), F.col("__ps")).when(F.col("__f").isNotNull(), F.col("__fs")).otherwise("none")
    return wanted.select("ticker").distinct().join(p, "ticker", "left").join(f, "ticker", "left").select("ticker", F.coalesce("__p", "__f").alias("last_price"), have.alias("source"))


def open_spells(attempts: DataFrame, *, by: str, at: str, failed: Column, after: int = 3, cool_seconds: int = 120) -> DataFrame:
    """by, opened_at, closed_at, failures: spells in which a source is left alone, from the attempt at which `after` in a row had failed to cool_seconds after the last failure: each further one puts the end off. Runs are islands between successes."""
    w = Window.partitionBy(by).orderBy(at)
    runs = attempts.select(by, at, failed.alias("__f")).withColumn("__run", F.sum(F.when(~F.col("__f"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(by, "__run").orderBy(at)
    counted = runs.filter("__f").withColumn("__nth", F.row_number().over(inside))
    spells = counted.groupBy(by, "__run").agg(F.max("__nth").alias("failures"), F.min(F.when(F.col("__nth") == after, F.col(at))).alias("opened_at"), F.max(at).alias("__last")).filter(F.col("failures") >= after)
    return spells.select(by, "opened_at", (F.col("__last") + F.expr(f"interval {cool_seconds} seconds")).alias("closed_at"), "failures")


#: What a provider is asked for where it has no bars of the wanted length.
INTERVALS = {"yfinance": {"4Hour": "60m", "1Hour": "60m", "1Min": "1m", "5Min": "5m", "15Min": "15m", "30Min": "30m", "1Day": "1d", "1Week": "1wk", "1Month": "1mo"}}


def interval_of(provider: str, timeframe: str) -> str:
    """The name of a bar length for a provider; unknown ones raise."""
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"unknown bar length: {timeframe}")
    return INTERVALS.get(provider, {}).get(timeframe, timeframe)


def landed_bars(df: DataFrame, provider: str, timeframe: str, *, is_fallback: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Bars of one provider as they were landed, under the common names and types, one for each ticker and time, with where they come from. Averages and counts of trades are dropped; missing columns are null."""
    interval_of(provider, timeframe)
    x = clean_bars(df, order).drop("vwap", "trade_count", "adj_close")
    given = {"source": F.lit(provider), "timeframe": F.lit(timeframe), "is_fallback": F.lit(is_fallback)}
    kinds = dict(c.strip().split(" ", 1) for c in BARS.split(","))
    return x.select(*[(given[c] if c in given else F.col(c) if c in x.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def read_pages(pages: DataFrame, *, by: str = "ticker", page: str = "page", size: int = 50, limit: int = 200, token: str | None = None, next_token: str | None = None) -> DataFrame:
    """The rows of landed pages that a reader would have come to: pages in order without a gap, no more than `limit`, up to the first that is short, and, with tokens, as long as each page is the one its predecessor names. Pages, not rows, are put in order, so a key costs as many rows as it has pages."""
    first = lambda c: F.first(c, ignorenulls=True).alias(f"__{c}")
    tokens = [first(c) for c in (token, next_token) if c]
    known = pages.groupBy(by, page).agg(F.count("*").alias("__n"), *tokens)
    w = Window.partitionBy(by).orderBy(page)
    ok = (F.col(page) == F.row_number().over(w)) & (F.coalesce(F.lag("__n").over(w), F.lit(size)) >= size)
    if token and next_token:
        ok &= (F.row_number().over(w) == 1) | F.coalesce(F.lag(f"__{next_token}").over(w) == F.col(f"__{token}"), F.lit(False))
    kept = known.withColumn("__ok", ok).withColumn("__all", F.min("__ok").over(w)).filter(F.col("__all") & (F.col(page) <= limit)).select(by, page)
    return pages.join(kept, [by, page], "left_semi")
