import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.functions import numeric as N
from quotemill.functions import text as T
from quotemill.functions.time import frame_start, to_utc
from quotemill.operators import bars as B
from quotemill.operators import performance as P
from tests.helpers import at

KIND = "ticker string, timestamp timestamp, open double, high double, low double, close double, volume double"


def random_bars(n=80, seed=1, ticker="A"):
    r = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    return [(ticker, at("2024-01-01") + dt.timedelta(days=i), float(c[i] - 1), float(c[i] + r.uniform(0, 3)), float(c[i] - r.uniform(0, 3)), float(c[i]), float(r.integers(1, 1000))) for i in range(n)]


def test_indicators_against_pandas(spark):
    data = random_bars()
    df = spark.createDataFrame(data, KIND)
    p = pd.DataFrame(data, columns="ticker timestamp open high low close volume".split())
    d = p.close.diff()
    ewm = lambda s: s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    rsi = 100 - 100 / (1 + ewm(d.clip(lower=0)) / ewm(-d.clip(upper=0)))
    got = B.rsi(df).orderBy("timestamp").toPandas()["rsi"]
    assert np.allclose(got, rsi, equal_nan=True) and got.first_valid_index() == 14
    tr = pd.concat([p.high - p.low, (p.high - p.close.shift()).abs(), (p.low - p.close.shift()).abs()], axis=1).max(axis=1)
    up, down = p.high.diff(), -p.low.diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    pd_, md = 100 * ewm(plus) / ewm(tr), 100 * ewm(minus) / ewm(tr)
    adx = ewm(100 * (pd_ - md).abs() / (pd_ + md))
    got = B.adx(df).orderBy("timestamp").toPandas()["adx"]
    assert np.allclose(got, adx, equal_nan=True) and got.first_valid_index() == 26
    sma = B.moving_averages(df, [20]).orderBy("timestamp").toPandas()["sma_20"]
    assert np.allclose(sma, p.close.rolling(20, min_periods=1).mean())


def test_all_gains_have_no_rsi(spark):
    data = [("A", at("2024-01-01") + dt.timedelta(days=i), 1.0, 1.0, 1.0, 100.0 + i, 1.0) for i in range(30)]
    assert B.rsi(spark.createDataFrame(data, KIND)).filter("rsi is not null").count() == 0


def test_clean_and_check(spark):
    df = spark.createDataFrame([(" a ", at("2024-01-01"), "1", "2", "0.5", "1.5", "10", 1), ("A", at("2024-01-01"), "9", "9", "9", "9", "9", 2), ("A", at("2024-01-02"), None, None, None, "x", "5", 3), (None, at("2024-01-02"), "1", "1", "1", "1", "1", 4)], "Symbol string, T timestamp, O string, H string, L string, C string, V string, seq int")
    rows = B.clean_bars(df, order=["seq"]).collect()
    assert [(r.ticker, r.close, r.volume) for r in rows] == [("A", 1.5, 10.0)]
    assert B.check_bars(B.clean_bars(df, order=["seq"])) == [] and B.check_bars(df) and B.check_bars(spark.createDataFrame([], KIND)) == ["no rows"]


def test_resample_and_frames(spark):
    df = spark.createDataFrame(random_bars(30), KIND)
    w = B.resample(df, "1Week").orderBy("bar_start").collect()
    assert sum(r.n for r in w) == 30 and all(r.low <= r.close <= r.high for r in w)
    with pytest.raises(ValueError):
        frame_start(F.col("timestamp"), "7Min")
    assert B.resample(df.limit(0), "1Day").count() == 0


def test_fallback_only_where_nothing_primary(spark):
    df = spark.createDataFrame([("A", False), ("A", True), ("B", True)], "ticker string, fb boolean")
    assert sorted(map(tuple, B.by_source(df, ["ticker"], F.col("fb")).collect())) == [("A", False), ("B", True)]


def test_performance(spark):
    data = [("A", at("2024-01-01") + dt.timedelta(days=i), v) for i, v in enumerate([100.0, 110.0, 90.0, 105.0])]
    s = P.summary(P.curve(spark.createDataFrame(data, "ticker string, timestamp timestamp, close double"))).first()
    assert s.max_drawdown == pytest.approx(-20 / 110) and s.total_return == pytest.approx(0.05)
    g = P.gains_and_losses(spark.createDataFrame([("A", x) for x in (100.0, -50.0, 80.0, -30.0)] + [("B", 5.0), ("C", -1.0)], "t string, x double"), by="t", gain=F.col("x"))
    got = {r.t: (r.profit_factor, r.win_rate) for r in g.collect()}
    assert got == {"A": (2.25, 0.5), "B": (None, 1.0), "C": (0.0, 0.0)}


def test_text_and_numbers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(T.without_markup(lit("<b>Wow</b>!!! see https://a.b/c now?!"))) == "Wow ! see now!"
    assert one(T.clean_headline(lit("  ﬁne\tday "))) == "fine day"
    assert one(T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(T.jaccard(T.word_set(lit("a b c d")), T.word_set(lit("A b c e")))) == 0.6
    title, source = T.title_and_source(lit("Up - and away - The Wire"))
    assert (one(title), one(source)) == ("Up - and away", "The Wire")
    assert one(T.title_and_source(lit("plain"))[1]) is None
    assert one(T.mentions(lit("Shares of abc rose"), lit("ABC"))) and not one(T.mentions(lit("abcd"), lit("ABC")))
    assert one(T.cache_key(lit("a/b"), lit("c: d"))) == "a_b_c__d"
    assert one(N.safe_long(lit("-3.7"), 0)) == -3 and one(N.safe_long(lit("x"), 7)) == 7 and one(N.safe_double(lit(None).cast("string"), 1.5)) == 1.5
    assert one(N.clamp(lit(11.0), 0, 10)) == 10.0 and one(N.clamp(lit(None).cast("double"), 0, 10)) is None
    assert [one(N.label_of(lit(x), 0.15)) for x in (0.15, 0.16, -0.16)] == ["NEUTRAL", "POSITIVE", "NEGATIVE"]
    assert one(F.unix_seconds(to_utc(lit("1700000000")))) == 1700000000 and one(to_utc(lit("soon"))) is None
    random.seed(1)
    u = [r.u for r in spark.range(2000).select(N.jitter(42, F.col("id")).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.03


@pytest.mark.parametrize("batch", [3, 10_000])
def test_means_go_on_from_batch_to_batch(spark, batch):
    r = random.Random(4)
    data = [(f"t{k % 3}" if k % 3 else None, k, None if r.random() < 0.4 else r.uniform(1, 9)) for k in range(90)]
    df = spark.createDataFrame(data, "ticker string, timestamp long, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = B.smoothed(df, {"a": ("x", 0.3, 4), "b": ("x", 0.9, 1)}).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == 90
    for key, g in got.groupby("ticker", dropna=False):
        g = g.sort_values("timestamp")
        for out, alpha, least in (("a", 0.3, 4), ("b", 0.9, 1)):
            want = g["x"].ewm(alpha=alpha, adjust=False, min_periods=least).mean()
            assert g[out].to_numpy() == pytest.approx(want.to_numpy(), nan_ok=True), key
