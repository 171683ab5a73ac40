"""Rows of nothing but nulls, and tables of only such rows, go through every operator."""

import pytest
from pyspark.sql import functions as F

from quotemill.operators.asof import asof_join
from quotemill.operators.bars import clean_bars, resample, rsi
from quotemill.operators.dedup import distinct_articles
from quotemill.operators.deliveries import latest_deliveries
from quotemill.operators.performance import curve, leaders, summary
from quotemill.operators.regrid import regular_grid
from quotemill.operators.rolling import trailing_totals
from quotemill.operators.spikes import implausible
from quotemill.operators.timestamps import normalise_timestamps

BARS = "bar_id long, ticker string, timestamp timestamp, open double, high double, low double, close double, volume double, ingested_at timestamp"
SESSIONS = "session_date date, open_at timestamp, close_at timestamp"
RAW = "rec_id long, kind string, feed string, published_at string, timestamp string, received_at timestamp"
FEEDS = "feed string, zone string, date_order string"
NEWS = "news_id long, ticker string, url string, article_id string, headline string, published_at timestamp"


def nulls(spark, kind, n=3):
    return spark.createDataFrame([(None,) * len(kind.split(","))] * n, kind)


@pytest.mark.parametrize("n", [0, 3])
def test_all_null(spark, n):
    bars, sessions, raw, feeds, news = (nulls(spark, k, n) for k in (BARS, SESSIONS, RAW, FEEDS, NEWS))
    assert latest_deliveries(bars).count() == min(n, 1)
    assert trailing_totals(bars).count() == 0
    assert regular_grid(bars, sessions).count() == 0
    assert normalise_timestamps(raw, feeds).count() == 0
    assert implausible(bars).filter("close_flag <> 'normal'").count() == 0 and implausible(bars).count() == n
    assert clean_bars(bars).count() == 0
    assert resample(bars, "1Day").count() == min(n, 1)
    assert rsi(bars).filter("rsi is not null").count() == 0
    assert summary(curve(bars)).count() == 0 and leaders(bars).count() == 0
    assert asof_join(bars, news, by="ticker", left_at="timestamp", right_at="published_at").filter(F.col("news_id").isNotNull()).count() == 0
    assert distinct_articles(news).count() == n
