"""Queries over price bars, and SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.columns import entity_key, utc_day
from quotemill.functions.numeric import jitter
from quotemill.functions.time import local_time, month_chunks
from quotemill.operators import bars as B
from quotemill.operators import performance as P
from quotemill.operators.deliveries import latest_deliveries
from quotemill.session import read
from quotemill.sources import feeds



def series():
    return Window.partitionBy("ticker").orderBy("timestamp")


def _us(c: str = "timestamp"):
    return F.unix_micros(c).alias(c)


def r6(c, name: str):
    """Rounded where engines may add in another order."""
    return F.round(c, 6).alias(name)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid daily bars by normalised ticker."""
    x = latest_deliveries(read(spark, sf_dir, "daily_bars").select("bar_id", "ticker", "timestamp", "open", "high", "low", "close", "volume", "source", "is_fallback", "ingested_at"))
    return x.withColumn("ticker", entity_key(F.col("ticker"))).drop("ingested_at")


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid daily bars with a positive close, the series that indicators run on."""
    return daily(spark, sf_dir).filter("close > 0").select("ticker", "timestamp", "close", "volume", "open", "high", "low")


def bars_clean(spark, d):
    raw = read(spark, d, "daily_bars").select("bar_id", "ticker", "timestamp", "open", "high", "low", "close", "volume")
    return B.clean_bars(raw, order=["bar_id", "volume", "close"]).select("bar_id", "ticker", _us(), "open", "high", "low", "close", "volume")


def bars_valid(spark, d):
    return daily(spark, d).select("bar_id", "ticker", _us(), "close", "volume")


def bars_scan(spark, d):
    """Bars asked for by ticker and period; every ticker asks for the year up to its last bar."""
    x = daily(spark, d).select("bar_id", "ticker", "timestamp", "close")
    asked = x.groupBy("ticker").agg(F.max("timestamp").alias("until"))
    return x.join(asked, "ticker").filter(F.col("timestamp") > F.col("until") - F.expr("interval 365 days")).select("bar_id", "ticker", _us(), "close")


def source_fallback(spark, d):
    x = daily(spark, d).withColumn("day", utc_day(F.col("timestamp")))
    return B.by_source(x, ["ticker", "day"], F.col("is_fallback")).groupBy("ticker", "is_fallback").agg(F.count("*").alias("bars"))


def latest_price(spark, d):
    x = daily(spark, d).filter("close is not null")
    pick = lambda f: x.filter(F.col("is_fallback") == f).groupBy("ticker").agg(F.max_by("close", "timestamp").alias("last_price"), F.max_by("source", "timestamp").alias("source"))
    return feeds.last_prices(read(spark, d, "tickers").select(entity_key(F.col("ticker")).alias("ticker")), pick(False), pick(True))


def latest_quote(spark, d):
    x = read(spark, d, "intraday_bars").filter("high is not null and low is not null")
    q = latest_deliveries(x.select("bar_id", "ticker", "timestamp", "high", "low", "ingested_at")).select(entity_key(F.col("ticker")).alias("ticker"), F.col("high").alias("ask_price"), F.col("low").alias("bid_price"), F.col("timestamp").alias("timestamp"))
    return feeds.quotes(q).select("ticker", "last_price", "ask_price", "bid_price", _us())


def _resampled(frame, table):
    def run(spark, d):
        x = latest_deliveries(read(spark, d, table).select("bar_id", "ticker", "timestamp", "open", "high", "low", "close", "volume", "ingested_at")).withColumn("ticker", entity_key(F.col("ticker")))
        y = B.resample(x, frame, order=F.struct("timestamp", "bar_id"))
        return y.select("ticker", _us("bar_start"), "open", "high", "low", "close", "volume", "n")

    return run


def sma_multi(spark, d):
    return B.moving_averages(closes(spark, d)).select("ticker", _us(), *[F.round(c, 9).alias(c) for c in ("sma_20", "sma_50", "sma_200")])


def daily_returns(spark, d):
    return closes(spark, d).select("ticker", _us(), B.returns().alias("daily_return"))


def _ohlc(spark, d):
    return daily(spark, d).filter("close > 0 and high is not null and low is not null").select("ticker", "timestamp", "close", "high", "low")


def true_range(spark, d):
    return _ohlc(spark, d).select("ticker", _us(), B.true_range().alias("true_range"))


def directional_move(spark, d):
    plus, minus = B.directional_moves()
    return _ohlc(spark, d).select("ticker", _us(), plus.alias("plus_dm"), minus.alias("minus_dm"))


def rsi14(spark, d):
    return B.rsi(closes(spark, d)).select("ticker", _us(), r6("rsi", "rsi_14"))


def adx14(spark, d):
    return B.adx(_ohlc(spark, d)).select("ticker", _us(), r6("plus_di", "plus_di"), r6("minus_di", "minus_di"), r6("adx", "adx_14"))


def ema_close(spark, d):
    return B.smoothed(closes(spark, d).select("ticker", "timestamp", "close"), {"ema": ("close", 1 / 3, 1)}).select("ticker", _us(), r6("ema", "ema_5"))


def momentum5(spark, d):
    return closes(spark, d).select("ticker", _us(), B.momentum(5).alias("momentum_5"))


def bar_index(spark, d):
    return closes(spark, d).select("ticker", _us(), (F.row_number().over(series()) - 1).alias("bar_index"))


def previous_bars(spark, d):
    w = series().rowsBetween(-3, -1)
    return closes(spark, d).select("ticker", _us(), F.array_join(F.transform(F.collect_list("close").over(w), lambda x: F.format_string("%.4f", x)), ",").alias("previous"))


def next_bar(spark, d):
    return closes(spark, d).select("ticker", _us(), F.lead("open").over(series()).alias("next_open"), F.coalesce(F.unix_micros(F.lead("timestamp").over(series())), F.unix_micros("timestamp")).alias("fill_at"))


def running_peak(spark, d):
    return P.curve(closes(spark, d)).select("ticker", _us(), "peak", r6("drop", "drop"))


def trailing_level(spark, d):
    return closes(spark, d).filter("high is not null").select("ticker", _us(), F.max(F.col("high") * 0.93).over(series().rowsBetween(Window.unboundedPreceding, 0)).alias("level"))


def first_last_bar(spark, d):
    return closes(spark, d).groupBy("ticker").agg(F.min_by("close", "timestamp").alias("first_close"), F.max_by("close", "timestamp").alias("last_close"), F.count("*").alias("bars"))


def benchmark_curve(spark, d):
    return P.curve(closes(spark, d)).select("ticker", _us(), r6(F.col("growth") * 100000, "equity"), r6(F.coalesce("change", F.lit(0.0)), "change"))


def curve_vs_benchmark(spark, d):
    c = P.curve(closes(spark, d)).withColumn("day", utc_day(F.col("timestamp")))
    b = c.filter("ticker = 'QZAR'").select("day", F.col("growth").alias("benchmark"))
    return c.join(b, "day", "left").select("ticker", F.date_format("day", "yyyy-MM-dd").alias("day"), r6("growth", "growth"), r6("benchmark", "benchmark"))


def performance(spark, d):
    s = P.summary(P.curve(closes(spark, d)))
    return s.select("ticker", "bars", *[r6(c, c) for c in ("total_return", "annual_return", "max_drawdown", "sharpe", "downside", "calmar")])


def trade_summary(spark, d):
    x = closes(spark, d).withColumn("r", B.returns())
    s = P.gains_and_losses(x, by="ticker", gain=F.col("r"))
    return s.select("ticker", "n", "wins", "losses", *[r6(c, c) for c in ("win_rate", "profit_factor", "avg_win", "avg_loss", "best", "worst", "total")])


def comparison(spark, d):
    """Measures of every ticker as rows, next to those of the benchmark."""
    s = P.summary(P.curve(closes(spark, d)))
    long = s.unpivot("ticker", ["total_return", "annual_return", "max_drawdown", "sharpe", "calmar"], "measure", "value")
    bench = long.filter("ticker = 'QZAR'").select("measure", F.col("value").alias("benchmark"))
    return long.join(F.broadcast(bench), "measure", "left").select("ticker", "measure", r6("value", "value"), r6("benchmark", "benchmark"))


def formatted_summary(spark, d):
    """Measures as they are printed; what is unknown as n/a."""
    s = P.summary(P.curve(closes(spark, d)))
    percent = lambda c: F.coalesce(F.format_string("%.1f%%", F.round(F.col(c) * 100, 1)), F.lit("n/a"))
    number = lambda c: F.coalesce(F.format_string("%.2f", F.round(c, 2)), F.lit("n/a"))
    return s.select("ticker", percent("total_return").alias("total_return"), percent("max_drawdown").alias("max_drawdown"), number("sharpe").alias("sharpe"))


def exposure(spark, d):
    return daily(spark, d).groupBy("ticker").agg((F.count_if(F.col("volume") > 0) / F.count("*")).alias("exposure"), F.count("*").alias("bars"))


def activity(spark, d):
    return P.activity(closes(spark, d)).select("ticker", "bars", F.round("money_volume", 2).alias("money_volume"), r6("volatility", "volatility"), r6("above_mean", "above_mean"))


def most_active(spark, d):
    """The ten tickers with the most money volume."""
    a = P.activity(closes(spark, d)).orderBy(F.desc_nulls_last("money_volume"), "ticker").limit(10)
    return a.select("ticker", F.round("money_volume", 2).alias("money_volume"), F.row_number().over(Window.orderBy(F.desc_nulls_last("money_volume"), "ticker")).alias("place"))


def _leaders(spark, d):
    return P.leaders(closes(spark, d))


def rotation_leaders(spark, d):
    return _leaders(spark, d).select(_us("as_of"), "place", "ticker")


def _active(spark, d):
    return _leaders(spark, d).groupBy("as_of").agg(F.array_sort(F.collect_list("ticker")).alias("active"))


def rotation_changes(spark, d):
    before = F.lag("active").over(Window.partitionBy(F.lit(0)).orderBy("as_of"))
    x = _active(spark, d).withColumn("before", before)
    joined = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    out = x.filter("before is not null").select(_us("as_of"), joined("active", "before").alias("added"), joined("before", "active").alias("removed"))
    return out.filter("added <> '' or removed <> ''")


def ever_active(spark, d):
    return _leaders(spark, d).select("ticker").distinct()


def rotation_members(spark, d):
    """Bars whose ticker is active on the last rotation date at or before them."""
    active = _active(spark, d)
    days = closes(spark, d).select("timestamp").distinct().join(active, F.col("timestamp") == F.col("as_of"), "left")
    held = F.last("active", True).over(Window.partitionBy(F.lit(0)).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0))
    filled = days.withColumn("held", held).select("timestamp", F.explode("held").alias("ticker"))
    return closes(spark, d).join(filled, ["ticker", "timestamp"], "left_semi").select("ticker", _us(), "close")


def last_per_day(spark, d):
    x = latest_deliveries(read(spark, d, "intraday_bars").select("bar_id", "ticker", "timestamp", "close", "ingested_at")).withColumn("ticker", entity_key(F.col("ticker"))).filter("close is not null")
    return x.groupBy("ticker", F.date_format(utc_day(F.col("timestamp")), "yyyy-MM-dd").alias("day")).agg(F.max_by("close", F.struct("timestamp", "bar_id")).alias("last_close"), F.count("*").alias("n"))


def threshold_sweep(spark, d):
    """A grid of thresholds against all bars; the grid is four rows."""
    grid = spark.createDataFrame([(0.01,), (0.02,), (0.05,), (0.1,)], "threshold double")
    x = closes(spark, d).withColumn("r", B.returns()).filter("r is not null")
    return x.crossJoin(F.broadcast(grid)).groupBy("threshold", "ticker").agg(F.count_if(F.abs("r") > F.col("threshold")).alias("days"))


def sessions_local(spark, d):
    x = read(spark, d, "sessions")
    return x.select(F.date_format("session_date", "yyyy-MM-dd").alias("session"), F.date_format(local_time(F.col("open_at")), "HH:mm").alias("opens"), F.date_format(local_time(F.col("close_at")), "HH:mm").alias("closes"), ((F.unix_micros("close_at") - F.unix_micros("open_at")) / 3.6e9).alias("hours"), "is_early_close")


def month_ranges(spark, d):
    x = daily(spark, d).groupBy("ticker").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return x.select("ticker", F.explode(month_chunks(F.col("a"), F.col("b"))).alias("c")).select("ticker", _us_of("c.chunk_start", "chunk_start"), _us_of("c.chunk_end", "chunk_end"))


def _us_of(c: str, name: str):
    return F.unix_micros(c).alias(name)


def sector_rollup(spark, d):
    t = read(spark, d, "tickers").select(entity_key(F.col("ticker")).alias("ticker"), F.coalesce("sector", F.lit("unknown")).alias("sector"), "exchange")
    x = closes(spark, d).join(t, "ticker")
    return x.rollup("sector", "exchange").agg(F.countDistinct("ticker").alias("tickers"), F.count("*").alias("bars"), F.max("close").alias("top"))


def hash_jitter(spark, d):
    """A reproducible number per ticker and day; its distribution, not its digits, is what counts."""
    x = daily(spark, d).select("ticker", "timestamp", jitter(42, F.col("ticker"), F.col("timestamp")).alias("u"))
    return x.select("ticker", _us(), "u")


QUERIES = {
    "bars_clean": bars_clean,
    "bars_valid": bars_valid,
    "bars_scan": bars_scan,
    "source_fallback": source_fallback,
    "latest_price": latest_price,
    "latest_quote": latest_quote,
    "bars_weekly": _resampled("1Week", "daily_bars"),
    "bars_monthly": _resampled("1Month", "daily_bars"),
    "bars_hourly": _resampled("1Hour", "intraday_bars"),
    "sma_multi": sma_multi,
    "daily_returns": daily_returns,
    "true_range": true_range,
    "directional_move": directional_move,
    "rsi14": rsi14,
    "adx14": adx14,
    "ema_close": ema_close,
    "momentum5": momentum5,
    "bar_index": bar_index,
    "previous_bars": previous_bars,
    "next_bar": next_bar,
    "running_peak": running_peak,
    "trailing_level": trailing_level,
    "first_last_bar": first_last_bar,
    "benchmark_curve": benchmark_curve,
    "curve_vs_benchmark": curve_vs_benchmark,
    "performance": performance,
    "trade_summary": trade_summary,
    "comparison": comparison,
    "formatted_summary": formatted_summary,
    "exposure": exposure,
    "activity": activity,
    "most_active": most_active,
    "rotation_leaders": rotation_leaders,
    "rotation_changes": rotation_changes,
    "ever_active": ever_active,
    "rotation_members": rotation_members,
    "last_per_day": last_per_day,
    "threshold_sweep": threshold_sweep,
    "sessions_local": sessions_local,
    "month_ranges": month_ranges,
    "sector_rollup": sector_rollup,
    "hash_jitter": hash_jitter,
}

# SQL. Valid deliveries and normalised tickers first; everything else builds on these.
_VALID = """valid AS (
  SELECT * EXCLUDE (ticker, nth), upper(trim(ticker)) AS ticker, epoch_us("timestamp") AS us
  FROM (SELECT *, row_number() OVER (PARTITION BY bar_id ORDER BY ingested_at DESC) AS nth FROM {table}) WHERE nth = 1
)"""
_D = "WITH " + _VALID.format(table="daily_bars")
_C = _D + ", c AS (SELECT ticker, us, \"timestamp\", \"open\", high, low, \"close\", volume FROM valid WHERE \"close\" > 0)"
_O = _D + ", c AS (SELECT ticker, us, high, low, \"close\" FROM valid WHERE \"close\" > 0 AND high IS NOT NULL AND low IS NOT NULL)"
_W = "OVER (PARTITION BY ticker ORDER BY us)"
_R = _C + f", r AS (SELECT *, CASE WHEN lag(\"close\") {_W} > 0 THEN \"close\" / lag(\"close\") {_W} - 1 END AS r FROM c)"
_CURVE = _C + f""", curve AS (
  SELECT ticker, us, "close", "close" / first_value("close") OVER (PARTITION BY ticker ORDER BY us) AS growth, "close" / lag("close") {_W} - 1 AS change,
  max("close") OVER (PARTITION BY ticker ORDER BY us ROWS UNBOUNDED PRECEDING) AS peak FROM c
), drops AS (SELECT *, "close" / peak - 1 AS drop_ FROM curve)"""


def _resample_sql(table: str, start: str) -> str:
    return f"""WITH {_VALID.format(table=table)}, b AS (SELECT *, {start} AS bar_start FROM valid)
SELECT ticker, bar_start, arg_min("open", (us, bar_id)) FILTER ("open" IS NOT NULL) AS "open", max(high) AS high, min(low) AS low, arg_max("close", (us, bar_id)) FILTER ("close" IS NOT NULL) AS "close", sum(volume) AS volume, count(*) AS n
FROM b GROUP BY ticker, bar_start"""


def _ewm_sql(source: str, columns: dict[str, tuple[str, float, int]]) -> str:
    """CTE e: exponentially weighted means of columns without gaps, in closed form over the rows of a series."""
    parts = []
    for out, (x, alpha, least) in columns.items():
        b = 1 - alpha
        w = "OVER (PARTITION BY ticker ORDER BY us ROWS UNBOUNDED PRECEDING)"
        terms = f"sum(CASE WHEN {x} IS NULL THEN 0 WHEN k = 0 THEN {x} ELSE {alpha!r} * {x} * pow({b!r}, -k) END) {w} * pow({b!r}, k)"
        parts.append(f"CASE WHEN count({x}) {w} >= {least} THEN {terms} END AS {out}")
    return f"SELECT *, {', '.join(parts)} FROM {source}"


_LEADERS = _C + """, m AS (SELECT ticker, us, "close" * volume AS money FROM c WHERE volume IS NOT NULL),
dates AS (SELECT us, row_number() OVER (ORDER BY us) - 1 AS d FROM (SELECT DISTINCT us FROM m)),
cuts AS (SELECT us AS as_of FROM dates WHERE d % 21 = 0),
recent AS (SELECT as_of, ticker, money, row_number() OVER (PARTITION BY as_of, ticker ORDER BY us DESC) AS nth FROM m JOIN cuts ON us <= as_of),
scored AS (SELECT as_of, ticker, avg(money) AS mv FROM recent WHERE nth <= 60 GROUP BY 1, 2),
lead4 AS (SELECT as_of, ticker, row_number() OVER (PARTITION BY as_of ORDER BY mv DESC, ticker) AS place FROM scored QUALIFY place <= 4)"""

_PERFORMANCE = f"""{_CURVE}, s AS (
  SELECT ticker, count(*) AS bars, arg_max(growth, us) - 1 AS tr, least(min(drop_), 0.0) AS dd, avg(change) / nullif(stddev_samp(change), 0) * sqrt(252) AS sh,
  CASE WHEN count(*) FILTER (change < 0) >= 2 THEN stddev_samp(change) FILTER (change < 0) * sqrt(252) END AS dn FROM drops GROUP BY ticker
), a AS (SELECT *, CASE WHEN bars > 1 AND tr > -1 THEN pow(1 + tr, 252.0 / (bars - 1)) - 1 END AS ar FROM s)"""

SQL = {
    "bars_clean": """SELECT bar_id, ticker, us AS "timestamp", "open", high, low, "close", volume FROM (
  SELECT *, upper(trim(ticker)) AS ticker_, epoch_us("timestamp") AS us, row_number() OVER (PARTITION BY upper(trim(ticker)), "timestamp" ORDER BY bar_id, volume NULLS LAST, "close" NULLS LAST) AS nth
  FROM daily_bars WHERE NOT ("open" IS NULL AND high IS NULL AND low IS NULL AND "close" IS NULL)
) WHERE nth = 1""",
    "bars_valid": f"{_D} SELECT bar_id, ticker, us AS \"timestamp\", \"close\", volume FROM valid",
    "bars_scan": f"{_D} SELECT bar_id, ticker, us AS \"timestamp\", \"close\" FROM valid QUALIFY us > max(us) OVER (PARTITION BY ticker) - 365 * 86400000000",
    "source_fallback": f"""{_D}, x AS (SELECT *, us // 86400000000 AS day FROM valid), p AS (SELECT DISTINCT ticker, day FROM x WHERE NOT is_fallback)
SELECT ticker, is_fallback, count(*) AS bars FROM x WHERE NOT is_fallback OR (ticker, day) NOT IN (SELECT (ticker, day) FROM p) GROUP BY ticker, is_fallback""",
    "latest_price": f"""{_D}, l AS (SELECT ticker, is_fallback, arg_max("close", us) AS p, arg_max(source, us) AS s FROM valid WHERE "close" IS NOT NULL GROUP BY 1, 2)
SELECT t.ticker, coalesce(a.p, b.p) AS last_price, CASE WHEN a.p IS NOT NULL THEN a.s WHEN b.p IS NOT NULL THEN b.s ELSE 'none' END AS source
FROM (SELECT DISTINCT upper(trim(ticker)) AS ticker FROM tickers) t LEFT JOIN l a ON a.ticker = t.ticker AND NOT a.is_fallback LEFT JOIN l b ON b.ticker = t.ticker AND b.is_fallback""",
    "latest_quote": """WITH valid AS (
  SELECT upper(trim(ticker)) AS ticker, epoch_us("timestamp") AS us, high, low FROM (SELECT *, row_number() OVER (PARTITION BY bar_id ORDER BY ingested_at DESC) AS nth FROM intraday_bars WHERE high IS NOT NULL AND low IS NOT NULL) WHERE nth = 1
) SELECT ticker, arg_max((high + low) / 2, us) AS last_price, arg_max(high, us) AS ask_price, arg_max(low, us) AS bid_price, max(us) AS "timestamp" FROM valid GROUP BY ticker""",
    "bars_weekly": _resample_sql("daily_bars", "epoch_us(date_trunc('week', timezone('UTC', \"timestamp\")))"),
    "bars_monthly": _resample_sql("daily_bars", "epoch_us(CAST(date_trunc('month', timezone('UTC', \"timestamp\")) AS TIMESTAMP))"),
    "bars_hourly": _resample_sql("intraday_bars", "us - us % 3600000000"),
    "sma_multi": f"{_C} SELECT ticker, us AS \"timestamp\", " + ", ".join(f"round(avg(\"close\") OVER (PARTITION BY ticker ORDER BY us ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 9) AS sma_{n}" for n in (20, 50, 200)) + " FROM c",
    "daily_returns": f"{_R} SELECT ticker, us AS \"timestamp\", r AS daily_return FROM r",
    "true_range": f"{_O}, x AS (SELECT *, lag(\"close\") {_W} AS pc FROM c) SELECT ticker, us AS \"timestamp\", greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range FROM x",
    "directional_move": f"""{_O}, x AS (SELECT *, high - lag(high) {_W} AS up, lag(low) {_W} - low AS down FROM c)
SELECT ticker, us AS "timestamp", CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS plus_dm, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS minus_dm FROM x""",
    "rsi14": f"""{_C}, x AS (SELECT ticker, us, "close" - lag("close") {_W} AS d, row_number() {_W} - 1 AS k FROM c),
g AS (SELECT ticker, us, k - 1 AS k, greatest(d, 0.0) AS gain, greatest(-d, 0.0) AS loss FROM x WHERE d IS NOT NULL), e AS ({_ewm_sql('g', {'a': ('gain', 1 / 14, 14), 'b': ('loss', 1 / 14, 14)})})
SELECT x.ticker, x.us AS "timestamp", CASE WHEN e.b > 0 THEN round(100 - 100 / (1 + e.a / e.b), 6) END AS rsi_14 FROM x LEFT JOIN e ON x.ticker = e.ticker AND x.us = e.us""",
    "adx14": f"""{_O}, x AS (SELECT *, high - lag(high) {_W} AS up, lag(low) {_W} - low AS down, lag("close") {_W} AS pc, row_number() {_W} - 1 AS k FROM c),
y AS (SELECT ticker, us, k, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS m FROM x),
e AS ({_ewm_sql('y', {'atr': ('tr', 1 / 14, 14), 'pe': ('p', 1 / 14, 14), 'me': ('m', 1 / 14, 14)})}),
z AS (SELECT ticker, us, k, 100 * pe / nullif(atr, 0) AS pd, 100 * me / nullif(atr, 0) AS md FROM e), v AS (SELECT *, 100 * abs(pd - md) / nullif(pd + md, 0) AS dx FROM z),
dense AS (SELECT ticker, us, k - min(k) OVER (PARTITION BY ticker) AS k, dx FROM v WHERE dx IS NOT NULL), f AS ({_ewm_sql('dense', {'a': ('dx', 1 / 14, 14)})})
SELECT v.ticker, v.us AS "timestamp", round(pd, 6) AS plus_di, round(md, 6) AS minus_di, round(a, 6) AS adx_14 FROM v LEFT JOIN f ON v.ticker = f.ticker AND v.us = f.us""",
    "ema_close": f"""{_C}, x AS (SELECT ticker, us, "close" AS x, row_number() {_W} - 1 AS k FROM c), e AS ({_ewm_sql('x', {'e': ('x', 1 / 3, 1)})}) SELECT ticker, us AS "timestamp", round(e, 6) AS ema_5 FROM e""",
    "momentum5": f"{_C} SELECT ticker, us AS \"timestamp\", \"close\" / coalesce(lag(\"close\", 5) {_W}, first_value(\"close\") {_W}) - 1 AS momentum_5 FROM c",
    "bar_index": f"{_C} SELECT ticker, us AS \"timestamp\", row_number() {_W} - 1 AS bar_index FROM c",
    "previous_bars": f"{_C} SELECT ticker, us AS \"timestamp\", coalesce(array_to_string(list_transform(list(\"close\") OVER (PARTITION BY ticker ORDER BY us ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda x: printf('%.4f', x)), ','), '') AS previous FROM c",
    "next_bar": f"{_C} SELECT ticker, us AS \"timestamp\", lead(\"open\") {_W} AS next_open, coalesce(lead(us) {_W}, us) AS fill_at FROM c",
    "running_peak": f"{_CURVE} SELECT ticker, us AS \"timestamp\", peak, round(drop_, 6) AS drop FROM drops",
    "trailing_level": f"{_C} SELECT ticker, us AS \"timestamp\", max(high * 0.93) OVER (PARTITION BY ticker ORDER BY us ROWS UNBOUNDED PRECEDING) AS level FROM c WHERE high IS NOT NULL",
    "first_last_bar": f"{_C} SELECT ticker, arg_min(\"close\", us) AS first_close, arg_max(\"close\", us) AS last_close, count(*) AS bars FROM c GROUP BY ticker",
    "benchmark_curve": f"{_CURVE} SELECT ticker, us AS \"timestamp\", round(growth * 100000, 6) AS equity, round(coalesce(change, 0.0), 6) AS change FROM curve",
    "curve_vs_benchmark": f"""{_CURVE}, x AS (SELECT ticker, us // 86400000000 AS day, growth FROM curve), b AS (SELECT day, growth AS bench FROM x WHERE ticker = 'QZAR')
SELECT x.ticker, strftime(DATE '1970-01-01' + CAST(x.day AS INTEGER), '%Y-%m-%d') AS day, round(growth, 6) AS growth, round(bench, 6) AS benchmark FROM x LEFT JOIN b ON x.day = b.day""",
    "performance": f"""{_PERFORMANCE} SELECT ticker, bars, round(tr, 6) AS total_return, round(ar, 6) AS annual_return, round(dd, 6) AS max_drawdown, round(sh, 6) AS sharpe, round(dn, 6) AS downside, round(ar / nullif(abs(dd), 0), 6) AS calmar FROM a""",
    "comparison": f"""{_PERFORMANCE}, l AS (SELECT ticker, unnest(['total_return', 'annual_return', 'max_drawdown', 'sharpe', 'calmar']) AS measure, unnest([tr, ar, dd, sh, ar / nullif(abs(dd), 0)]) AS v FROM a)
SELECT l.ticker, l.measure, round(l.v, 6) AS value, round(b.v, 6) AS benchmark FROM l LEFT JOIN l b ON b.measure = l.measure AND b.ticker = 'QZAR'""",
    "formatted_summary": f"""{_PERFORMANCE} SELECT ticker, coalesce(printf('%.1f%%', round(tr * 100, 1)), 'n/a') AS total_return, coalesce(printf('%.1f%%', round(dd * 100, 1)), 'n/a') AS max_drawdown, coalesce(printf('%.2f', round(sh, 2)), 'n/a') AS sharpe FROM a""",
    "trade_summary": f"""{_R} SELECT ticker, count(*) AS n, count(*) FILTER (r > 0) AS wins, count(*) FILTER (r < 0) AS losses, round(count(*) FILTER (r > 0) / count(*), 6) AS win_rate,
  round(coalesce(sum(r) FILTER (r > 0), 0) / nullif(abs(sum(r) FILTER (r < 0)), 0), 6) AS profit_factor, round(avg(r) FILTER (r > 0), 6) AS avg_win, round(avg(r) FILTER (r <= 0), 6) AS avg_loss,
  round(max(r), 6) AS best, round(min(r), 6) AS worst, round(sum(r), 6) AS total FROM r WHERE r IS NOT NULL GROUP BY ticker""",
    "exposure": f"{_D} SELECT ticker, count(*) FILTER (volume > 0) / count(*) AS exposure, count(*) AS bars FROM valid GROUP BY ticker",
    "activity": f"""{_R}, x AS (SELECT *, avg("close") OVER (PARTITION BY ticker ORDER BY us ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sma FROM r)
SELECT ticker, count(*) AS bars, round(avg("close" * volume), 2) AS money_volume, round(CASE WHEN count(r) > 5 THEN stddev_samp(r) * sqrt(252) * 100 END, 6) AS volatility, round(avg(CASE WHEN "close" > sma THEN 1.0 ELSE 0.0 END), 6) AS above_mean FROM x GROUP BY ticker""",
    "most_active": f"{_C}, x AS (SELECT ticker, avg(\"close\" * volume) AS mv FROM c GROUP BY ticker ORDER BY mv DESC NULLS LAST, ticker LIMIT 10) SELECT ticker, round(mv, 2) AS money_volume, row_number() OVER (ORDER BY mv DESC NULLS LAST, ticker) AS place FROM x",
    "rotation_leaders": f"{_LEADERS} SELECT as_of, place, ticker FROM lead4",
    "rotation_changes": f"""{_LEADERS}, a AS (SELECT as_of, list_sort(list(ticker)) AS now_ FROM lead4 GROUP BY as_of), b AS (SELECT as_of, now_, lag(now_) OVER (ORDER BY as_of) AS was FROM a)
SELECT as_of, array_to_string(list_filter(now_, lambda x: NOT list_contains(was, x)), ',') AS added, array_to_string(list_filter(was, lambda x: NOT list_contains(now_, x)), ',') AS removed FROM b WHERE was IS NOT NULL AND now_ <> was""",
    "ever_active": f"{_LEADERS} SELECT DISTINCT ticker FROM lead4",
    "rotation_members": f"""{_LEADERS}, days AS (SELECT DISTINCT us FROM c), at_ AS (SELECT d.us, k.as_of FROM days d ASOF JOIN cuts k ON d.us >= k.as_of)
SELECT c.ticker, c.us AS "timestamp", c."close" FROM c JOIN at_ ON c.us = at_.us JOIN lead4 l ON l.as_of = at_.as_of AND l.ticker = c.ticker""",
    "last_per_day": f"""WITH {_VALID.format(table='intraday_bars')} SELECT ticker, strftime(DATE '1970-01-01' + CAST(us // 86400000000 AS INTEGER), '%Y-%m-%d') AS day, arg_max("close", (us, bar_id)) AS last_close, count(*) AS n FROM valid WHERE "close" IS NOT NULL GROUP BY 1, 2""",
    "threshold_sweep": f"{_R} SELECT threshold, ticker, count(*) FILTER (abs(r) > threshold) AS days FROM r, (SELECT unnest([0.01::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS threshold) WHERE r IS NOT NULL GROUP BY 1, 2",
    "sessions_local": """SELECT strftime(session_date, '%Y-%m-%d') AS session, strftime(timezone('America/New_York', open_at), '%H:%M') AS opens, strftime(timezone('America/New_York', close_at), '%H:%M') AS closes, (epoch_us(close_at) - epoch_us(open_at)) / 3.6e9 AS hours, is_early_close FROM sessions""",
    "month_ranges": f"""{_D}, s AS (SELECT ticker, min(us) AS a, max(us) AS b FROM valid GROUP BY 1),
m AS (SELECT ticker, a, b, unnest(generate_series(date_trunc('month', make_timestamp(a)), make_timestamp(b), INTERVAL 1 MONTH)) AS m FROM s)
SELECT ticker, greatest(epoch_us(m), a) AS chunk_start, least(epoch_us(m + INTERVAL 1 MONTH), b) AS chunk_end FROM m WHERE greatest(epoch_us(m), a) < least(epoch_us(m + INTERVAL 1 MONTH), b)""",
    "sector_rollup": f"""{_C}, x AS (SELECT c.ticker, c."close", coalesce(t.sector, 'unknown') AS sector, t.exchange FROM c JOIN tickers t ON upper(trim(t.ticker)) = c.ticker)
SELECT sector, exchange, count(DISTINCT ticker) AS tickers, count(*) AS bars, max("close") AS top FROM x GROUP BY ROLLUP (sector, exchange)""",
}
