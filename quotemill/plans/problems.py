"""Queries of the general data-processing problems, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.columns import floor_div
from quotemill.operators.deliveries import latest_deliveries
from quotemill.operators.regrid import regular_grid, unread_slots
from quotemill.operators.rolling import busier_than_usual, trailing_totals
from quotemill.operators.spikes import implausible
from quotemill.operators.timestamps import normalise_timestamps
from quotemill.session import read


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_deliveries(read(spark, sf_dir, "daily_bars").select("bar_id", "ticker", "timestamp", "close", "volume", "ingested_at"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busier_than_usual(trailing_totals(_daily(spark, sf_dir), values=("volume",)))


def p2_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trailing_totals(_daily(spark, sf_dir))
    return x.select("ticker", F.date_format("trade_day", "yyyy-MM-dd").alias("trade_day"), *[F.col(c).cast("double").alias(c) if c.startswith("total_") else F.col(c) for c in x.columns[2:]])


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = latest_deliveries(read(spark, sf_dir, "intraday_bars").select("bar_id", "ticker", "timestamp", "close", "ingested_at"))
    return regular_grid(bars, read(spark, sf_dir, "sessions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unread_slots(_grid(spark, sf_dir))


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid; rounded where engines may add in another order."""
    x = _grid(spark, sf_dir)
    rounded = [F.round(c, 4).alias(c) for c in ("value", "weight", "support")]
    return x.select("ticker", F.col("session_date").cast("string").alias("session_date"), floor_div(F.unix_micros("slot_start"), 1_000_000).alias("slot_start"), "n_readings", *rounded, "status")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_timestamps(read(spark, sf_dir, "raw_feed"), read(spark, sf_dir, "feeds")).select("rec_id", "utc_us")


def p6_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(_daily(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_flags(spark, sf_dir).filter("close_flag <> 'normal' or volume_flag <> 'normal'").select("bar_id")


def p6_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags that rules alone define: broken bounds and stuck values."""
    hard = lambda c: F.when(F.col(c).isin("stuck", "out_of_range"), F.col(c)).otherwise("").alias(c)
    return p6_flags(spark, sf_dir).select("bar_id", hard("close_flag"), hard("volume_flag")).filter("close_flag <> '' or volume_flag <> ''")


QUERIES = {"p2_found": p2_found, "p2_trailing": p2_trailing, "p4_found": p4_found, "p4_grid": p4_grid, "p5_found": p5_found, "p6_found": p6_found, "p6_flags": p6_flags, "p6_hard": p6_hard}

_BARS = """valid AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bar_id ORDER BY ingested_at DESC) AS nth FROM {table}) WHERE nth = 1
), keyed AS (SELECT *, upper(trim(ticker)) AS tk, timezone('UTC', "timestamp") AS ts FROM valid WHERE trim(ticker) <> '')"""

_TRAILING = f"""WITH {_BARS.format(table='daily_bars')},
daily AS (
  SELECT tk, CAST(ts AS DATE) AS d, sum(CAST(volume AS DECIMAL(30,6))) AS v, count(volume) AS nv, sum(CAST("close" AS DECIMAL(30,6))) AS c, count("close") AS nc FROM keyed GROUP BY 1, 2
), span AS (SELECT tk, min(d) AS lo, max(d) AS hi FROM daily GROUP BY 1),
grid AS (SELECT tk, lo, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM span),
filled AS (
  SELECT g.tk, g.d, date_diff('day', g.lo, g.d) + 1 AS day_no, coalesce(v, 0) AS v, coalesce(nv, 0) AS nv, coalesce(c, 0) AS c, coalesce(nc, 0) AS nc FROM grid g LEFT JOIN daily USING (tk, d)
)"""


def _windowed(v: str, name: str, n: int) -> str:
    over = f"OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    total = f"CAST(sum({v}) {over} AS DECIMAL(38,6))"
    return f"""CAST({total} AS DOUBLE) AS total_{name}_{n}, CAST({total} AS DOUBLE) / {n} AS avg_{name}_{n}, CAST(sum(CASE WHEN n{v} > 0 THEN 1 ELSE 0 END) {over} AS BIGINT) AS seen_{name}_{n},
  CAST({total} AS DOUBLE) / nullif(sum(n{v}) {over}, 0) AS mean_{name}_{n}"""


_SLOTS = f"""WITH {_BARS.format(table='intraday_bars')},
r AS (
  SELECT k.tk, s.session_date, epoch_us(s.open_at) AS o, epoch_us(s.close_at) AS c, (epoch_us(k."timestamp") - epoch_us(s.open_at)) // 900000000 AS k,
    ((epoch_us(k."timestamp") - epoch_us(s.open_at)) % 900000000) / 900000000.0 - 0.5 AS x, k."close" AS y
  FROM keyed k JOIN sessions s ON k."timestamp" >= s.open_at AND k."timestamp" < s.close_at WHERE k."close" IS NOT NULL
), used AS (SELECT DISTINCT tk, session_date, o, c FROM r),
slots AS (SELECT tk, session_date, o, unnest(generate_series(0, (c - o - 1) // 900000000)) AS g FROM used)"""

_RUNS = ", ".join(f"""CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN count(*) OVER (PARTITION BY tk, {c}, {n}_run) ELSE 1 END AS {n}_length""" for c, n in (('"close"', "close"), ("volume", "volume")))
_SAME = ", ".join(f"""sum(CASE WHEN {c} = before_{n} THEN 0 ELSE 1 END) OVER (PARTITION BY tk ORDER BY ts, bar_id ROWS UNBOUNDED PRECEDING) AS {n}_run""" for c, n in (('"close"', "close"), ("volume", "volume")))

SQL = {
    "p6_hard": f"""WITH {_BARS.format(table='daily_bars')},
b AS (SELECT *, lag("close") OVER (PARTITION BY tk ORDER BY ts, bar_id) AS before_close, lag(volume) OVER (PARTITION BY tk ORDER BY ts, bar_id) AS before_volume FROM keyed WHERE ts IS NOT NULL),
g AS (SELECT *, {_SAME} FROM b), l AS (SELECT *, {_RUNS} FROM g),
f AS (SELECT bar_id, CASE WHEN "close" <= 0 THEN 'out_of_range' WHEN close_length >= 5 THEN 'stuck' ELSE '' END AS close_flag, CASE WHEN volume < 0 THEN 'out_of_range' WHEN volume_length >= 5 THEN 'stuck' ELSE '' END AS volume_flag FROM l)
SELECT * FROM f WHERE close_flag <> '' OR volume_flag <> ''""",
    "p4_grid": f"""{_SLOTS},
near AS (
  SELECT s.tk, s.session_date, s.o, s.g, r.k, r.x + (r.k - s.g) AS u, r.y, 1 - (r.x + (r.k - s.g)) * (r.x + (r.k - s.g)) / 2.25 AS w
  FROM slots s JOIN r ON r.tk = s.tk AND r.session_date = s.session_date AND r.o = s.o AND r.k BETWEEN s.g - 1 AND s.g + 1
), sides AS (
  SELECT tk, session_date, o, g, k, count(*) AS n, sum(u) AS d1, sum(w) AS w0, sum(w * u) AS w1, sum(w * u * u) AS w2, sum(w * w) AS q, sum(w * y) AS y0, sum(w * u * y) AS y1 FROM near GROUP BY ALL
), sums AS (
  SELECT tk, session_date, o, g, sum(CASE WHEN k = g THEN n ELSE 0 END) AS n, sum(w0) AS w0, sum(w1) AS w1, sum(w2) AS w2, sum(q) AS q, sum(y0) AS y0, sum(y1) AS y1, bool_or(d1 < 0) AND bool_or(d1 > 0) AS both_sides
  FROM sides GROUP BY ALL
), fits AS (
  SELECT s.tk, s.session_date, s.o, s.g, coalesce(n, 0) AS n, coalesce(w0, 0) AS w0, CASE WHEN w0 >= 1e-12 THEN w0 * w0 / q ELSE 0 END AS support,
    CASE WHEN both_sides AND w0 * w2 - w1 * w1 > 0.01 * w0 * w0 THEN (w2 * y0 - w1 * y1) / (w0 * w2 - w1 * w1) WHEN w0 >= 1e-12 THEN y0 / w0 END AS fit
  FROM slots s LEFT JOIN sums USING (tk, session_date, o, g)
), marks AS (SELECT *, CASE WHEN n > 0 THEN 'read' WHEN w0 >= 0.1 AND support >= 1 - 1e-9 THEN 'filled' ELSE 'missing' END AS status FROM fits)
SELECT tk AS ticker, CAST(session_date AS VARCHAR) AS session_date, o // 1000000 + g * 900 AS slot_start, CAST(n AS BIGINT) AS n_readings,
  round(CASE WHEN status <> 'missing' THEN fit END, 4) AS value, round(w0, 4) AS weight, round(support, 4) AS support, status FROM marks""",
    "p2_found": f"""{_TRAILING}, t AS (
  SELECT tk, d, day_no, sum(v) OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS v7, sum(v) OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS v30 FROM filled
) SELECT tk AS ticker, strftime(d, '%Y-%m-%d') AS trade_day FROM t WHERE day_no >= 30 AND v7 * 60 > v30 * 21""",
    "p2_trailing": f"{_TRAILING} SELECT tk AS ticker, strftime(d, '%Y-%m-%d') AS trade_day, CAST(day_no AS INTEGER) AS day_no, {_windowed('v', 'volume', 7)}, {_windowed('v', 'volume', 30)}, {_windowed('c', 'close', 7)}, {_windowed('c', 'close', 30)} FROM filled",
    "p4_found": f"""WITH {_BARS.format(table='intraday_bars')},
hit AS (
  SELECT DISTINCT k.tk, s.open_at, s.close_at, CAST(floor((epoch_us(k."timestamp") - epoch_us(s.open_at)) / 900000000) AS BIGINT) AS slot
  FROM keyed k JOIN sessions s ON k."timestamp" >= s.open_at AND k."timestamp" < s.close_at WHERE k."close" IS NOT NULL
), used AS (SELECT DISTINCT tk, open_at, close_at FROM hit),
slots AS (SELECT tk, open_at, unnest(generate_series(0, (epoch_us(close_at) - epoch_us(open_at) - 1) // 900000000)) AS slot FROM used)
SELECT tk AS ticker, epoch_us(open_at) // 1000000 + slot * 900 AS slot_start FROM slots ANTI JOIN hit USING (tk, open_at, slot)""",
}
