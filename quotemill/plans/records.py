"""Queries on records as they are checked, landed, cached and reported, and SQL for each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions import text as T
from quotemill.functions.columns import blank_to_null, entity_key
from quotemill.operators import checks as C
from quotemill.operators import performance as P
from quotemill.operators import sentiment as S
from quotemill.operators.bars import returns
from quotemill.plans.articles import _BLANK, _N, _SCORED, _SIGNALS, MAX_BROADCAST_TICKERS, _signals, news, scored
from quotemill.plans.market import _C, _D, _PERFORMANCE, _R, closes, daily, latest_price
from quotemill.plans.market import SQL as MARKET_SQL
from quotemill.session import broadcast_within, read
from quotemill.sources import feeds, tables

NOW = "2025-03-01 00:00:00"
NOW_US = 1_740_787_200_000_000


def _us(c: str):
    return F.coalesce(F.unix_micros(c), F.lit(-1)).alias(c)


def _marked(df: DataFrame, rules: C.Rules, *keys: str) -> DataFrame:
    return df.select(*keys, F.array_join(C.broken(rules), ",").alias("broken"))


def valid_items(spark: SparkSession, d: str) -> DataFrame:
    return _marked(news(spark, d), C.item(), "news_id")


def valid_market_rows(spark, d):
    """Every valid delivery of a daily bar with what keeps it from being used."""
    return _marked(daily(spark, d), C.market_row(), "bar_id")


def quarantined_rows(spark, d):
    """How many bars are set aside, by what is wrong with them."""
    good, bad = C.parted(daily(spark, d), C.market_row() | C.live_market())
    count = lambda x, why: x.groupBy(why.alias("why")).agg(F.count("*").alias("n"))
    return count(good, F.lit("none")).unionByName(count(bad, F.array_join("broken", ",")))


def valid_snapshots(spark, d):
    return _marked(scored(spark, d), C.snapshot(), "news_id")


def valid_results(spark, d):
    x = _signals(spark, d).withColumns({c: F.round(c, 6) for c in ("direction", "conviction")}).withColumn("articles", F.when(F.col("articles") > 1, F.col("articles")).otherwise(0))
    return _marked(x, C.ticker_result(), "ticker", "day")


def valid_messages(spark, d):
    """Orders as records for another system: their state out of a list, a whole size above zero."""
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("state"), F.col("l_quantity").alias("size"), F.col("l_linestatus").alias("ticker"))
    return _marked(x, C.message("state", ("A", "N"), quantity="size"), "l_orderkey", "l_linenumber").filter("broken <> ''")


def config_checks(spark, d):
    """A run for each listed ticker from its first to its last bar: what is wrong with its settings."""
    spans = closes(spark, d).groupBy("ticker").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.max("close").alias("top"))
    listed = read(spark, d, "tickers").select(entity_key(F.col("ticker")).alias("ticker"), "sector")
    runs = listed.join(spans, "ticker", "left").select("ticker", F.when(F.col("sector").isNotNull(), F.array("ticker")).otherwise(F.array().cast("array<string>")).alias("tickers"), (F.col("top") - 100).alias("capital"), "start", "end")
    return _marked(runs, C.run_settings(), "ticker")


class _Offline:
    """A scorer that is there but fails on every batch, as a model does whose service is down."""

    name = "offline"

    def available(self) -> bool:
        return True

    def score(self, texts: pd.Series) -> pd.DataFrame:
        raise ConnectionError("no answer")


def scorer_failover(spark, d):
    """The next scorer takes what the first one fails on."""
    x = news(spark, d).filter(F.col("ticker").isNotNull() & blank_to_null(F.col("headline")).isNotNull())
    y = S.score_with(x.select("news_id", F.concat_ws(" ", "headline", "snippet").alias("analysis_text")), [_Offline(), S.WordScorer()], batch=256, required=True)
    return y.select("news_id", "sentiment", F.round("conviction", 6).alias("conviction"), "scored_by")


def landed_bars(spark, d):
    """Daily bars as a provider sends them, under short names and as text, read into the common schema."""
    x = daily(spark, d)
    raw = x.select(F.col("ticker").alias("Symbol"), F.col("timestamp").alias("T"), *[F.col(c).cast("string").alias(c[0].upper()) for c in ("open", "high", "low", "close")], F.col("volume").cast("string").alias(" V "), F.lit("1.5").alias("vw"), F.lit(3).alias("n"), (F.col("close") / 2).alias("Adj Close"))
    bars = feeds.landed_bars(raw, "yfinance", "1Day", is_fallback=True)
    return bars.select("ticker", _us("timestamp"), "open", "high", "low", "close", "volume", "source", "timeframe", "is_fallback")


def landed_pages(spark, d):
    """News in pages of 5 for each provider and ticker, newest first, of which a reader comes to five at most and stops at a short one; page 3 of the tickers whose name ends in a vowel was lost."""
    newest = Window.partitionBy("provider", "ticker").orderBy(F.desc_nulls_last("published_at"), "news_id")
    x = news(spark, d).filter("ticker is not null").withColumn("page", F.floor((F.row_number().over(newest) - 1) / 5).cast("int") + 1)
    x = x.filter(~(F.col("ticker").rlike("[AEIOU]$") & (F.col("page") == 3))).withColumn("feed", F.concat_ws("/", "provider", "ticker"))
    x = x.withColumns({"token": F.concat("feed", F.lit("/"), F.col("page")), "next_token": F.concat("feed", F.lit("/"), F.col("page") + 1)})
    return feeds.read_pages(x, by="feed", size=5, limit=5, token="token", next_token="next_token").select("news_id", "page")


def two_tier_cache(spark, d):
    """Incoming headlines looked up among scores kept for a short time, then among those kept for good."""
    key = T.fingerprint(F.col("headline")).alias("k")
    old = read(spark, d, "news").filter("headline is not null").select(key, "news_id", "batch_no", "ingested_at").groupBy("k").agg(F.max("news_id").alias("value"), F.max("ingested_at").alias("at"), F.min("batch_no").alias("b"))
    memory = old.filter("b % 3 = 0").select("k", "value", (F.col("at") + F.expr("interval 30 days")).alias("expires_at"))
    found, kept = tables.two_tier(read(spark, d, "news_incoming").filter("headline is not null").select(key), memory, old.select("k", "value"), key="k", ttl_seconds=3600, now=F.lit(NOW).cast("timestamp"))
    return found.join(kept.select("k", _us("expires_at")), "k", "left").select("k", F.coalesce("value", F.lit(-1)).alias("value"), "tier", F.coalesce("expires_at", F.lit(-1)).alias("expires_at"))


def cache_counts(spark, d):
    """Entries, stale ones, and incoming headlines that hit or miss, for each provider."""
    key = T.fingerprint(F.col("headline")).alias("k")
    old = read(spark, d, "news").filter("headline is not null").groupBy("provider", key).agg(F.max("ingested_at").alias("at"))
    new = read(spark, d, "news_incoming").filter("headline is not null").select("provider", key)
    stale = F.col("at") + F.expr("interval 30 days") < F.lit(NOW).cast("timestamp")
    sizes = old.groupBy("provider").agg(F.count("*").alias("entries"), F.count_if(stale).alias("stale"))
    hits = new.join(old.select("provider", "k", F.lit(1).alias("hit")), ["provider", "k"], "left").groupBy("provider").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sizes.join(hits, "provider", "full").select("provider", *[zero(c) for c in ("entries", "stale", "hits", "misses")])


def cache_without(spark, d):
    """What is left of the kept articles once those of the incoming batches' tickers are invalidated."""
    keys = news(spark, d).select("ticker").distinct().join(read(spark, d, "news_incoming").filter("batch_no = 101").select(entity_key(F.col("ticker")).alias("ticker")).distinct(), "ticker", "left_semi")
    return tables.without_keys(news(spark, d).filter("ticker is not null").select("news_id", "ticker"), keys, "ticker")


def rank_functions(spark, d):
    """Where each close stands among those of its ticker, and how many closes lie within 5 % below it."""
    w = Window.partitionBy("ticker").orderBy("close", "timestamp")
    near = Window.partitionBy("ticker").orderBy("cents").rangeBetween(-500, 0)
    x = closes(spark, d).withColumn("cents", F.floor(F.col("close") * 100).cast("long"))
    return x.select("ticker", F.unix_micros("timestamp").alias("timestamp"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("percent_rank"), F.round(F.cume_dist().over(w), 9).alias("cume_dist"), F.count("*").over(near).alias("near"))


def map_functions(spark, d):
    """Languages of each provider's articles as a map: defaults under it, values by name, entries as rows."""
    lang = F.coalesce(F.lower(F.trim("language")), F.lit("none"))
    counts = news(spark, d).groupBy("provider", lang.alias("lang")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("provider").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("found"))
    defaults = F.create_map(F.lit("en"), F.lit(0).cast("long"), F.lit("fi"), F.lit(0).cast("long"))
    # Values that were found stand before the defaults of the same name.
    merged = F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key("found", k)), F.col("found"))
    rows = maps.select("provider", F.coalesce(F.try_element_at("found", F.lit("xx")), F.lit(-1)).alias("by_default"), F.explode(F.map_entries(merged)).alias("e"))
    return rows.select("provider", "by_default", F.col("e.key").alias("lang"), F.col("e.value").alias("n"))


def search_terms(spark, d):
    """What to search for each ticker of the news: the company's name where it is listed, else the ticker itself with a word that tells what it is."""
    terms = read(spark, d, "tickers").select(entity_key(F.col("ticker")).alias("ticker"), blank_to_null(F.col("company")).alias("company"))
    asked = news(spark, d).filter("ticker is not null").select("ticker").distinct()
    return asked.join(broadcast_within(terms, MAX_BROADCAST_TICKERS), "ticker", "left").select("ticker", F.coalesce("company", F.concat("ticker", F.lit(" stock"))).alias("term"))


def marked_values(spark, d):
    """Ten pieces of every ticker, taken at its first close, at the latest price; where there is none, or it is 0, at what was paid."""
    held = closes(spark, d).groupBy("ticker").agg(F.min_by("close", "timestamp").alias("paid"))
    price = F.coalesce(F.nullif("last_price", F.lit(0.0)), "paid")
    return held.join(latest_price(spark, d).select("ticker", "last_price"), "ticker", "left").select("ticker", "paid", F.round(price * 10, 6).alias("value"), F.round((price - F.col("paid")) * 10, 6).alias("gain"))


def parameter_grid(spark, d):
    """Measures of every ticker for every pair of threshold and direction; the grid is six rows."""
    grid = spark.createDataFrame([(t, s) for t in (0.01, 0.02, 0.05) for s in (-1, 1)], "threshold double, side int")
    x = closes(spark, d).withColumn("r", returns()).withColumn("after", F.lead("r").over(Window.partitionBy("ticker").orderBy("timestamp"))).filter("r is not null")
    hit = F.col("r") * F.col("side") > F.col("threshold")
    after = F.when(hit, F.col("after"))
    return x.crossJoin(F.broadcast(grid)).groupBy("threshold", "side", "ticker").agg(F.count_if(hit).alias("signals"), F.count(after).alias("followed"), F.count_if(after * F.col("side") > 0).alias("right"), F.round(F.max(after), 6).alias("best"), F.round(F.min(after), 6).alias("worst"))


def narrative(spark, d):
    """Sentences on every ticker, by section."""
    s = P.summary(P.curve(closes(spark, d)))
    percent = lambda c: F.format_string("%.1f%%", F.round(F.abs(F.col(c)) * 100, 1))
    moved = F.when(F.col("total_return").isNull(), "is unknown").when(F.col("total_return") >= 0, F.concat(F.lit("gained "), percent("total_return"))).otherwise(F.concat(F.lit("lost "), percent("total_return")))
    depth = F.when(F.col("max_drawdown") < 0, F.concat(F.lit("fell "), percent("max_drawdown"), F.lit(" from its peak at worst"))).otherwise("never stood below its peak")
    line = lambda name, text: F.struct(F.lit(name).alias("section"), F.concat("ticker", F.lit(" "), text, F.lit(".")).alias("text"))
    return s.select("ticker", F.explode(F.array(line("return", moved), line("risk", depth))).alias("x")).select("ticker", "x.section", "x.text")


def report_lines(spark, d):
    """The summary as rows of text, in the order they are printed."""
    s = narrative(spark, d)
    return s.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), " ").alias("report"))


QUERIES = {
    f.__name__: f
    for f in (
        valid_items, valid_market_rows, quarantined_rows, valid_snapshots, valid_results, valid_messages, config_checks, scorer_failover, landed_bars, landed_pages, two_tier_cache, cache_counts, cache_without,
        rank_functions, map_functions, search_terms, marked_values, parameter_grid, narrative, report_lines,
    )
}


def _broken(**rules: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in rules.items()) + ") AS broken"


_FINGERPRINT = r"substr(md5(trim(regexp_replace(regexp_replace(lower(headline), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g'))), 1, 12)"
_HAS = {c: _BLANK.format(c=c) for c in ("ticker", "headline", "source")}
_LABEL = "sentiment IN ('POSITIVE', 'NEGATIVE', 'NEUTRAL')"
_NUMBER = "{c} IS NOT NULL AND NOT isnan({c})"
_MARKET = {"ticker": _HAS["ticker"], "timestamp": "us IS NOT NULL", "high": "high IS NOT NULL", "low": "low IS NOT NULL", "volume": "volume IS NOT NULL", "open": _NUMBER.format(c='"open"'), "close": _NUMBER.format(c='"close"')}
_NARRATIVE = f"""{_PERFORMANCE}, t AS (
  SELECT ticker, unnest(['return', 'risk']) AS section, unnest([
    CASE WHEN tr IS NULL THEN 'is unknown' WHEN tr >= 0 THEN 'gained ' || printf('%.1f%%', round(abs(tr) * 100, 1)) ELSE 'lost ' || printf('%.1f%%', round(abs(tr) * 100, 1)) END,
    CASE WHEN dd < 0 THEN 'fell ' || printf('%.1f%%', round(abs(dd) * 100, 1)) || ' from its peak at worst' ELSE 'never stood below its peak' END]) AS said FROM a
), lines AS (SELECT ticker, section, ticker || ' ' || said || '.' AS text FROM t)"""

SQL = {
    "valid_items": f"{_N} SELECT news_id, {_broken(news_id='news_id IS NOT NULL', **_HAS, published_at='us IS NOT NULL')} FROM n",
    "valid_market_rows": f"{_D} SELECT bar_id, {_broken(**_MARKET)} FROM valid",
    "quarantined_rows": f"""{_D}, b AS (SELECT {_broken(**(_MARKET | {'close': '"close" > 0'}))} FROM valid) SELECT CASE WHEN broken = '' THEN 'none' ELSE broken END AS why, count(*) AS n FROM b GROUP BY 1""",
    "valid_snapshots": f"{_SCORED} SELECT news_id, {_broken(ticker=_HAS['ticker'], sentiment=_LABEL, conviction='conviction BETWEEN 0 AND 10', published_at='us IS NOT NULL')} FROM s",
    "valid_results": f"{_SIGNALS} SELECT ticker, day, {_broken(ticker=_HAS['ticker'], sentiment=_LABEL, direction='round(direction, 6) BETWEEN -1 AND 1', conviction='round(conviction, 6) BETWEEN 0 AND 10', articles='articles > 1')} FROM sign",
    "valid_messages": f"""SELECT * FROM (SELECT l_orderkey, l_linenumber, {_broken(ticker=_BLANK.format(c='l_linestatus'), state="l_returnflag IN ('A', 'N')", size='l_quantity > 0 AND l_quantity = floor(l_quantity)')} FROM lineitem) WHERE broken <> ''""",
    "config_checks": f"""{_C}, spans AS (SELECT ticker, min(us) AS a, max(us) AS b, max("close") AS top FROM c GROUP BY 1)
SELECT t.ticker, {_broken(tickers='sector IS NOT NULL', capital='top - 100 > 0', start='a IS NOT NULL', end='b IS NOT NULL', order='a < b')} FROM (SELECT upper(trim(ticker)) AS ticker, sector FROM tickers) t LEFT JOIN spans USING (ticker)""",
    "scorer_failover": f"{_SCORED} SELECT news_id, sentiment, round(conviction, 6) AS conviction, 'words' AS scored_by FROM s",
    "landed_bars": f"""{_D}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker, us ORDER BY "open" NULLS LAST, high NULLS LAST, low NULLS LAST, "close" NULLS LAST, volume NULLS LAST) AS nth FROM valid WHERE ticker <> '' AND us IS NOT NULL AND coalesce("open", high, low, "close") IS NOT NULL)
SELECT ticker, us AS "timestamp", "open", high, low, "close", volume, 'yfinance' AS source, '1Day' AS timeframe, true AS is_fallback FROM k WHERE nth = 1""",
    "landed_pages": f"""{_N}, p AS (SELECT news_id, provider, ticker, (row_number() OVER (PARTITION BY provider, ticker ORDER BY us DESC NULLS LAST, news_id) - 1) // 5 + 1 AS page FROM n WHERE ticker IS NOT NULL),
l AS (SELECT * FROM p WHERE NOT (regexp_matches(ticker, '[AEIOU]$') AND page = 3)), c AS (SELECT provider, ticker, page, count(*) AS k FROM l GROUP BY 1, 2, 3),
o AS (SELECT *, page = row_number() OVER w AND coalesce(lag(k) OVER w, 5) >= 5 AS ok FROM c WINDOW w AS (PARTITION BY provider, ticker ORDER BY page)),
r AS (SELECT *, bool_and(ok) OVER (PARTITION BY provider, ticker ORDER BY page) AS fine FROM o)
SELECT news_id, CAST(page AS INTEGER) AS page FROM l JOIN r USING (provider, ticker, page) WHERE fine AND page <= 5""",
    "two_tier_cache": f"""WITH o AS (SELECT {_FINGERPRINT} AS k, max(news_id) AS value, max(epoch_us(ingested_at)) AS seen, min(batch_no) AS b FROM news WHERE headline IS NOT NULL GROUP BY 1),
m AS (SELECT k, value, seen + 2592000000000 AS e FROM o WHERE b % 3 = 0 AND (seen IS NULL OR seen + 2592000000000 >= {NOW_US})), w AS (SELECT DISTINCT {_FINGERPRINT} AS k FROM news_incoming WHERE headline IS NOT NULL)
SELECT w.k, coalesce(m.value, o.value, -1) AS value, CASE WHEN m.k IS NOT NULL THEN 'memory' WHEN o.k IS NOT NULL THEN 'disk' ELSE 'none' END AS tier,
  CASE WHEN m.k IS NOT NULL THEN coalesce(m.e, -1) WHEN o.k IS NOT NULL THEN {NOW_US + 1_800_000_000} ELSE -1 END AS expires_at FROM w LEFT JOIN m ON m.k = w.k LEFT JOIN o ON o.k = w.k""",
    "cache_counts": f"""WITH o AS (SELECT provider, {_FINGERPRINT} AS k, max(epoch_us(ingested_at)) AS seen FROM news WHERE headline IS NOT NULL GROUP BY 1, 2), n AS (SELECT provider, {_FINGERPRINT} AS k FROM news_incoming WHERE headline IS NOT NULL),
s AS (SELECT provider, count(*) AS entries, count(*) FILTER (seen + 2592000000000 < {NOW_US}) AS stale FROM o GROUP BY 1), h AS (SELECT n.provider, count(o.k) AS hits, count(*) FILTER (o.k IS NULL) AS misses FROM n LEFT JOIN o ON o.provider = n.provider AND o.k = n.k GROUP BY 1)
SELECT provider, coalesce(entries, 0) AS entries, coalesce(stale, 0) AS stale, coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses FROM s FULL JOIN h USING (provider)""",
    "cache_without": f"{_N} SELECT news_id, ticker FROM n WHERE ticker IS NOT NULL AND ticker NOT IN (SELECT upper(trim(ticker)) FROM news_incoming WHERE batch_no = 101 AND trim(ticker) <> '')",
    "rank_functions": f"""{_C}, x AS (SELECT *, CAST(floor("close" * 100) AS BIGINT) AS cents FROM c)
SELECT ticker, us AS "timestamp", CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(percent_rank() OVER w, 9) AS percent_rank, round(cume_dist() OVER w, 9) AS cume_dist, count(*) OVER (PARTITION BY ticker ORDER BY cents RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near
FROM x WINDOW w AS (PARTITION BY ticker ORDER BY "close", us)""",
    "map_functions": f"""{_N}, k AS (SELECT provider, coalesce(lower(trim(language)), 'none') AS lang, count(*) AS n FROM n GROUP BY 1, 2)
SELECT provider, -1::BIGINT AS by_default, lang, n FROM k UNION ALL SELECT provider, -1, lang, 0 FROM (SELECT DISTINCT provider FROM k), (SELECT unnest(['en', 'fi']) AS lang) d WHERE (provider, lang) NOT IN (SELECT (provider, lang) FROM k)""",
    "search_terms": f"""{_N} SELECT a.ticker, coalesce(CASE WHEN {_BLANK.format(c='company')} THEN company END, a.ticker || ' stock') AS term FROM (SELECT DISTINCT ticker FROM n WHERE ticker IS NOT NULL) a LEFT JOIN tickers t ON upper(trim(t.ticker)) = a.ticker""",
    "marked_values": f"""WITH prices AS ({MARKET_SQL['latest_price']}), {_C.removeprefix('WITH ')}, h AS (SELECT ticker, arg_min("close", us) AS paid FROM c GROUP BY 1)
SELECT h.ticker, paid, round(coalesce(nullif(last_price, 0), paid) * 10, 6) AS value, round((coalesce(nullif(last_price, 0), paid) - paid) * 10, 6) AS gain FROM h LEFT JOIN prices p ON p.ticker = h.ticker""",
    "parameter_grid": f"""{_R}, f AS (SELECT *, lead(r) OVER (PARTITION BY ticker ORDER BY us) AS nxt FROM r), g AS (SELECT * FROM (SELECT unnest([0.01::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE]) AS threshold), (SELECT unnest([-1, 1]) AS side))
SELECT threshold, side, ticker, count(*) FILTER (r * side > threshold) AS signals, count(nxt) FILTER (r * side > threshold) AS followed, count(*) FILTER (r * side > threshold AND nxt * side > 0) AS "right",
  round(max(nxt) FILTER (r * side > threshold), 6) AS best, round(min(nxt) FILTER (r * side > threshold), 6) AS worst FROM f, g WHERE r IS NOT NULL GROUP BY 1, 2, 3""",
    "narrative": f"{_NARRATIVE} SELECT ticker, section, text FROM lines",
    "report_lines": f"{_NARRATIVE} SELECT ticker, string_agg(text, ' ' ORDER BY section) AS report FROM lines GROUP BY ticker",
}
