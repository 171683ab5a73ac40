import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotemill.operators import checks as C
from quotemill.operators.bars import standard_names
from quotemill.sources import feeds, tables
from tests.helpers import at

BAR = "ticker string, timestamp timestamp, open string, high double, low double, close string, volume double"


def test_broken_rules_in_their_order(spark):
    rows = [("A", at("2024-01-01"), "1", 1.0, 1.0, "2.5", 3.0), (" ", None, "x", None, 1.0, None, 3.0), (None, at("2024-01-01"), "1", 1.0, 1.0, "NaN", None), (None,) * 7]
    df = spark.createDataFrame(rows, BAR)
    got = [r.b for r in df.select(C.broken(C.market_row()).alias("b")).collect()]
    assert got == [[], ["ticker", "timestamp", "high", "open", "close"], ["ticker", "volume", "close"], ["ticker", "timestamp", "high", "low", "volume", "open", "close"]]
    good, bad = C.parted(df, C.market_row())
    assert good.count() == 1 and bad.count() == 3 and good.columns == df.columns
    none = spark.createDataFrame([], BAR)
    assert [x.count() for x in C.parted(none, C.market_row())] == [0, 0]


def test_scored_records(spark):
    df = spark.createDataFrame([("A", "POSITIVE", 10.0, 0.5, 1), ("A", "positive", 10.5, 2.0, 0), ("A", None, None, None, None)], "ticker string, sentiment string, conviction double, direction double, articles int")
    got = [r.b for r in df.select(C.broken(C.ticker_result()).alias("b")).collect()]
    assert got == [[], ["sentiment", "direction", "conviction", "articles"], ["sentiment", "direction", "conviction", "articles"]]
    orders = spark.createDataFrame([("A", "buy", "3"), ("A", "hold", "2.5"), ("A", "sell", "0"), ("A", "sell", "x")], "ticker string, side string, qty string")
    assert [r.b for r in orders.select(C.broken(C.message("side", ("buy", "sell"), quantity="qty")).alias("b")).collect()] == [[], ["side", "qty"], ["qty"], ["qty"]]


def test_settings():
    env = {"QUOTEMILL_DATA": "/d", "QUOTEMILL_OUT": "/o", "QUOTEMILL_TICKERS": "a, B ,", "QUOTEMILL_MONTHS": "3"}
    s = C.Settings.from_environment(env, months=6, period=None)
    assert (s.data, s.tickers, s.months, s.period, s.problems()) == ("/d", ("A", "B"), 6, 14, [])
    assert C.Settings.from_environment({}).problems() == ["data", "out"]
    assert C.Settings.from_environment(env, capital=0.0, start="2024-02-01", end="2024-01-01").problems() == ["capital", "start"]
    with pytest.raises(ValueError, match="QUOTEMILL_MONTHS"):
        C.Settings.from_environment({"QUOTEMILL_MONTHS": "many"})


def test_adjusted_close_is_no_close(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`Adj Close` double, `Close` double")
    assert standard_names(df).first().asDict() == {"adj_close": 1.0, "close": 2.0}


def test_landed_bars(spark):
    raw = spark.createDataFrame([("a", at("2024-01-01"), "1", "2"), ("a", at("2024-01-01"), "3", "4"), (None, None, None, None)], "Symbol string, t timestamp, c string, v string").withColumns({c: F.col("c") for c in "ohl"})
    got = feeds.landed_bars(raw, "yfinance", "4Hour", is_fallback=True, order=["close"]).collect()
    assert len(got) == 1 and (got[0].ticker, got[0].close, got[0].source, got[0].timeframe, got[0].is_fallback, got[0].currency) == ("A", 1.0, "yfinance", "4Hour", True, None)
    assert feeds.interval_of("yfinance", "4Hour") == "60m" and feeds.interval_of("alpaca", "4Hour") == "4Hour"
    with pytest.raises(ValueError):
        feeds.landed_bars(raw, "yfinance", "3Hour")


def test_pages_end_where_a_reader_would(spark):
    rows = []
    for feed, pages in {"a": {1: 3, 2: 3, 3: 1, 4: 3}, "b": {1: 3, 3: 3}, "c": {2: 3}, "d": {k: 3 for k in range(1, 9)}}.items():
        rows += [(feed, p, f"{feed}{p}", f"{feed}{p + 1}" if (feed, p) != ("d", 4) else "?") for p, n in pages.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "ticker string, page int, token string, next string")
    seen = lambda x: {(r.ticker, r.page) for r in x.collect()}
    assert seen(feeds.read_pages(df, size=3, limit=6)) == {("a", 1), ("a", 2), ("a", 3), ("b", 1), *[("d", k) for k in range(1, 7)]}
    assert seen(feeds.read_pages(df, size=3, limit=6, token="token", next_token="next")) == {("a", 1), ("a", 2), ("a", 3), ("b", 1), *[("d", k) for k in range(1, 5)]}
    assert feeds.read_pages(df.limit(0)).count() == 0


def test_two_tiers(spark):
    now = at("2024-01-01T12:00:00")
    memory = spark.createDataFrame([("m", 1, now + dt.timedelta(minutes=5)), ("stale", 2, now - dt.timedelta(minutes=5))], "k string, value int, expires_at timestamp")
    disk = spark.createDataFrame([("m", 9), ("stale", 3), ("d", 4)], "k string, value int")
    wanted = spark.createDataFrame([(k,) for k in ("m", "m", "stale", "d", "gone", None)], "k string")
    found, after = tables.two_tier(wanted, memory, disk, key="k", ttl_seconds=3600, now=F.lit(now))
    assert {r.k: (r.value, r.tier) for r in found.collect()} == {"m": (1, "memory"), "stale": (3, "disk"), "d": (4, "disk"), "gone": (None, "none"), None: (None, "none")}
    assert {r.k: (r.value, r.expires_at.replace(tzinfo=dt.timezone.utc) - now) for r in after.collect()} == {"m": (1, dt.timedelta(minutes=5)), "stale": (3, dt.timedelta(minutes=30)), "d": (4, dt.timedelta(minutes=30))}
    assert tables.without_keys(disk, wanted, "k").count() == 0


def test_a_failing_run_puts_the_end_off(spark):
    rows = [("s", at("2024-01-01") + dt.timedelta(seconds=10 * i), i not in (3, 9)) for i in range(12)]
    got = feeds.open_spells(spark.createDataFrame(rows, "s string, t timestamp, f boolean"), by="s", at="t", failed=F.col("f")).collect()
    ends = {(int((r.opened_at.replace(tzinfo=dt.timezone.utc) - at("2024-01-01")).total_seconds()), int((r.closed_at.replace(tzinfo=dt.timezone.utc) - at("2024-01-01")).total_seconds()), r.failures) for r in got}
    assert ends == {(20, 140, 3), (60, 200, 5)}
