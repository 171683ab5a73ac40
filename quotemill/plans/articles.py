"""Queries over news, documents, feeds and events, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions import numeric as N
from quotemill.functions import text as T
from quotemill.functions.columns import blank_to_null, entity_key, utc_day
from quotemill.functions.time import hours_between, month_chunks, within
from quotemill.operators import sentiment as S
from quotemill.operators.asof import asof_join
from quotemill.operators.bars import momentum, smoothed
from quotemill.operators.dedup import distinct_articles, first_by_key, first_of_similar
from quotemill.operators.similar import similar_pairs
from quotemill.plans.market import closes
from quotemill.session import broadcast_within, read
from quotemill.sources import feeds
from quotemill.sources.tables import latest_by, scored_and_new
from quotemill.streaming import windows as E

#: Tickers whose keywords may be broadcast.
MAX_BROADCAST_TICKERS = 50_000
PRIORITY = ["alpaca", "fmp", "finnhub", "rss"]
START, END = "2025-02-20 00:00:00", "2025-03-20 00:00:00"


def _us(c: str, name: str | None = None):
    return F.unix_micros(c).alias(name or c)


def _us_or(c: str, default: int = -1):
    """Whole numbers without nulls, which engines hand over in different types."""
    return F.coalesce(F.unix_micros(c), F.lit(default)).alias(c)


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News with normalised tickers and the UTC day of publication."""
    return read(spark, sf_dir, "news").withColumn("ticker", entity_key(F.col("ticker"))).withColumn("day", F.date_format(utc_day(F.col("published_at")), "yyyy-MM-dd"))


def valid_articles(spark, d):
    x = news(spark, d)
    return x.filter(x["ticker"].isNotNull() & blank_to_null(F.col("headline")).isNotNull()).select("news_id", "ticker", "provider", _us_or("published_at"))


def article_checks(spark, d):
    """Why articles are turned away, with how many."""
    why = F.when(blank_to_null(F.col("headline")).isNull(), "headline").when(blank_to_null(F.col("url")).isNull(), "url").when(F.col("published_at").isNull(), "published_at").otherwise("valid")
    return news(spark, d).groupBy(why.alias("why")).agg(F.count("*").alias("n"))


def filled_articles(spark, d):
    x = news(spark, d)
    return x.select("news_id", T.first_filled(F.col("headline"), F.col("snippet")).alias("title"), T.first_filled(F.col("source"), F.col("provider")).alias("source"), T.first_filled(F.col("url"), F.col("article_id")).alias("link"), F.lower(F.coalesce("language", F.lit("unknown"))).alias("language"))


def provider_union(spark, d):
    """Providers one after the other; the last one only for tickers with few articles of the others."""
    x = news(spark, d)
    main = feeds.in_order([x.filter(F.col("provider") == p) for p in PRIORITY[:-1]])
    extra = x.filter(F.col("provider") == PRIORITY[-1]).withColumn("provider_priority", F.lit(len(PRIORITY) - 1))
    return feeds.supplemented(main, extra, least=60).select("news_id", "ticker", "provider", "provider_priority")


def provider_histogram(spark, d):
    return news(spark, d).groupBy("provider").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"))


def window_filter(spark, d):
    return news(spark, d).filter(within(F.col("published_at"), F.lit(START).cast("timestamp"), F.lit(END).cast("timestamp"))).select("news_id", _us_or("published_at"))


def newest_first(spark, d):
    """The twenty newest articles; those without a date come last."""
    return news(spark, d).orderBy(F.desc_nulls_last("published_at"), "news_id").limit(20).select("news_id", _us("published_at"))


def ticker_mentions(spark, d):
    x = read(spark, d, "documents").filter("ticker is not null and text is not null")
    return x.groupBy(entity_key(F.col("ticker")).alias("ticker")).agg(F.count("*").alias("docs"), F.count_if(T.mentions(F.col("text"), F.col("ticker"))).alias("mentioning"))


def enriched_items(spark, d):
    x = news(spark, d)
    return x.select("news_id", T.analysis_text(F.col("headline"), F.col("snippet")).alias("analysis_text"), F.length(F.coalesce("snippet", F.lit(""))).alias("snippet_chars"))


def clean_text(spark, d):
    """All steps but the Unicode form, which SQL lacks."""
    return news(spark, d).filter("snippet is not null").select("news_id", T.without_markup(F.concat(F.lit("<p>See https://x.example/a?b=1 "), F.col("snippet"), F.lit("</p>  Really?! ..."))).alias("text"))


def clean_headline(spark, d):
    return news(spark, d).filter("headline is not null").select("news_id", T.clean_headline(F.col("headline")).alias("headline"))


def headline_fingerprint(spark, d):
    return news(spark, d).filter("headline is not null").select("news_id", T.fingerprint(F.col("headline")).alias("fingerprint"))


def content_hash(spark, d):
    x = news(spark, d)
    return x.select("news_id", T.content_hash(F.col("ticker"), F.col("headline"), F.col("snippet"), F.col("published_at")).alias("content_hash"))


def title_source(spark, d):
    title, source = T.title_and_source(F.concat(F.coalesce("headline", F.lit("untitled")), F.lit(" - "), F.col("source")))
    return news(spark, d).filter("source is not null").select("news_id", title.alias("title"), source.alias("source"))


def related_tickers(spark, d):
    x = news(spark, d).filter("related_tickers is not null")
    return x.select("news_id", F.explode("related_tickers").alias("related")).groupBy("related").agg(F.count("*").alias("n"))


def cache_keys(spark, d):
    x = news(spark, d).filter("published_at is not null")
    return x.select("news_id", T.cache_key(F.lit("news"), F.col("ticker"), F.date_format("published_at", "yyyy-MM-dd HH:mm")).alias("key"))


def safe_numbers(spark, d):
    raw = F.coalesce("published_at", "timestamp")
    return read(spark, d, "raw_feed").select("rec_id", N.safe_double(raw, -1.0).alias("as_double"), N.safe_long(raw, -1).alias("as_long"))


def json_roundtrip(spark, d):
    """Rows as JSON lines and back by schema: times are times again."""
    x = news(spark, d).select("news_id", "ticker", "headline", "published_at", "related_tickers")
    text = x.select(F.to_json(F.struct("*")).alias("j"))
    back = text.select(F.from_json("j", "news_id long, ticker string, headline string, published_at timestamp, related_tickers array<string>").alias("r")).select("r.*")
    return back.select("news_id", "ticker", "headline", F.coalesce(F.unix_millis("published_at"), F.lit(-1)).alias("published_ms"), F.size(F.coalesce("related_tickers", F.array())).alias("related"))


def csv_lines(spark, d):
    x = read(spark, d, "tickers")
    return x.select(F.to_csv(F.struct("ticker", "company", "sector")).alias("line"))


def dedup_url(spark, d):
    return first_by_key(news(spark, d), "url", ["news_id"], ["ticker"]).select("news_id")


def dedup_similar(spark, d):
    return first_of_similar(news(spark, d).filter("ticker is not null"), key="news_id", text="headline", within=("ticker",)).select("news_id")


def dedup_three_pass(spark, d):
    return distinct_articles(news(spark, d).filter("ticker is not null")).select("news_id")


def jaccard_pairs(spark, d):
    x = news(spark, d).withColumn("words", T.word_set(F.coalesce("headline", F.lit(""))))
    return similar_pairs(x, key="news_id", words="words", similarity=0.6, within=("ticker", "day")).select("a", "b", F.round("overlap", 6).alias("overlap"))


def keywords(spark, d) -> DataFrame:
    """Each ticker with the word that names its company and the words that name the other companies of its sector (at most ten, by ticker)."""
    listed = read(spark, d, "tickers").select(entity_key(F.col("ticker")).alias("ticker"), "sector", F.lower(F.split("company", " ")[0]).alias("keyword")).filter("ticker is not null").dropDuplicates(["ticker"])
    by_sector = Window.partitionBy("sector").orderBy("ticker")
    # Eleven words of a sector are enough to have ten besides one's own.
    named = listed.filter("sector is not null and keyword is not null").withColumn("n", F.row_number().over(by_sector)).filter("n <= 11").groupBy("sector").agg(F.array_sort(F.collect_list(F.struct("n", "keyword"))).alias("peers"))
    others = F.slice(F.filter(F.transform("peers", lambda x: x["keyword"]), lambda w: w != F.col("keyword")), 1, 10)
    return listed.join(named, "sector", "left").select("ticker", "keyword", F.coalesce(others, F.array().cast("array<string>")).alias("competitors"))


def scored(spark, d) -> DataFrame:
    """Articles with sentiment and conviction by word lists, and relevance: 1.0 where the headline names the company, 0.8 where it names a competitor, else by the provider."""
    x = news(spark, d).filter(F.col("ticker").isNotNull() & blank_to_null(F.col("headline")).isNotNull()).join(broadcast_within(keywords(spark, d), MAX_BROADCAST_TICKERS), "ticker", "left")
    head = F.lower("headline")
    relevance = F.when(F.contains(head, F.col("keyword")), 1.0).when(F.exists("competitors", lambda w: F.contains(head, w)), 0.8).when(F.col("provider") == "rss", 0.3).otherwise(0.9)
    x = x.select("news_id", "ticker", "day", "headline", "snippet", "published_at", "provider", relevance.alias("relevance"))
    x = S.with_lexicon_scores(x, F.concat_ws(" ", "headline", "snippet"))
    return x.select("news_id", "ticker", "day", "headline", "published_at", "provider", "sentiment", "conviction", "relevance")


def article_sentiment(spark, d):
    return scored(spark, d).select("news_id", "sentiment", F.round("conviction", 6).alias("conviction"), "relevance")


def batch_scores(spark, d):
    """Scores of a scorer object in Arrow batches, as a model would be run."""
    x = news(spark, d).filter(F.col("ticker").isNotNull() & blank_to_null(F.col("headline")).isNotNull())
    y = S.score_with(x.select("news_id", F.concat_ws(" ", "headline", "snippet").alias("analysis_text")), [S.WordScorer()], batch=256)
    return y.select("news_id", "sentiment", F.round("conviction", 6).alias("conviction"), "scored_by")


def signal_reasons(spark, d):
    """A sentence on each signal: counts by label and the article that weighs most."""
    x = _clustered(spark, d)
    n = lambda s: F.count_if(F.col("sentiment") == s)
    top = F.max_by("headline", F.struct("conviction", -F.col("news_id")))
    return x.groupBy("ticker", "day").agg(F.format_string("%d positive, %d negative, %d neutral in %d events; most: %s", n("POSITIVE"), n("NEGATIVE"), n("NEUTRAL"), F.countDistinct("cluster"), F.substring(top, 1, 120)).alias("reason"))


def label_histogram(spark, d):
    x = scored(spark, d).groupBy("ticker").agg(*[F.count_if(F.col("sentiment") == s).alias(s.lower()) for s in ("POSITIVE", "NEGATIVE", "NEUTRAL")], F.max_by("news_id", F.struct("conviction", -F.col("news_id"))).alias("top_article"))
    return x


def recency_weights(spark, d):
    ref = F.lit(END).cast("timestamp")
    return news(spark, d).select("news_id", F.round(S.recency_weight(F.col("published_at"), ref), 6).alias("weight"), F.round(hours_between(ref, F.col("published_at")), 9).alias("age_hours"))


def _clustered(spark, d):
    return S.event_clusters(scored(spark, d).filter("day is not null"))


def event_clusters(spark, d):
    return _clustered(spark, d).select("news_id", "cluster", "cluster_size")


def _signals(spark, d):
    ref = F.col("day").cast("timestamp") + F.expr("interval 1439 minutes")
    return S.ticker_signals(_clustered(spark, d), reference=ref)


def daily_sentiment(spark, d):
    return _signals(spark, d).select("ticker", "day", F.round("direction", 6).alias("direction"), F.round("conviction", 6).alias("conviction"), "sentiment", "articles", "events")


def rolling_sentiment(spark, d):
    """Exponential mean of the signed conviction of each ticker's days."""
    x = _signals(spark, d).select("ticker", "day", (N.direction(F.col("sentiment")) * F.col("conviction")).alias("signed"))
    return smoothed(x, {"e": ("signed", 1 / 3, 1)}, order=("day",)).select("ticker", "day", F.round("e", 6).alias("rolling"))


def quiet_days(spark, d):
    """Trading days of a ticker without any article, with the move over five bars that stands in."""
    x = closes(spark, d).select("ticker", "timestamp", F.date_format(utc_day(F.col("timestamp")), "yyyy-MM-dd").alias("day"), momentum(5).alias("m"))
    covered = news(spark, d).select("ticker", "day").distinct()
    return x.join(covered, ["ticker", "day"], "left_anti").select("ticker", "day", F.round("m", 6).alias("momentum"), N.label_of(F.col("m"), 0.02).alias("sentiment"))


def peer_strength(spark, d):
    """For each signal, other tickers of the same day that are strongly positive, and the conviction left after 5 % off for each, 25 % at most. One count per day, not a join of all with all."""
    x = _signals(spark, d)
    strong = (F.col("sentiment") == "POSITIVE") & (F.col("conviction") > 5)
    days = x.groupBy("day").agg(F.count_if(strong).alias("strong_day"))
    peers = F.col("strong_day") - strong.cast("int")
    return x.join(days, "day").select("ticker", "day", peers.alias("peers"), F.round(F.col("conviction") * (1 - F.least(F.lit(0.25), peers * 0.05)), 6).alias("dampened"))


def _snaps(spark, d):
    return scored(spark, d).filter("published_at is not null").select("news_id", "ticker", "published_at", "sentiment")


def _asof(spark, d, **options):
    bars = closes(spark, d).select("ticker", "timestamp", "close")
    return asof_join(bars, _snaps(spark, d), by="ticker", left_at="timestamp", right_at="published_at", right_order=["news_id"], **options).select("ticker", _us("timestamp"), F.coalesce("news_id", F.lit(-1)).alias("news_id"), "sentiment")


def asof_sentiment(spark, d):
    return _asof(spark, d)


def asof_offset(spark, d):
    return _asof(spark, d, offset_seconds=6 * 3600)


def asof_tolerance(spark, d):
    return _asof(spark, d, tolerance_seconds=24 * 3600)


def lookahead_audit(spark, d):
    """Signals that are later than the bar they were matched to: none."""
    x = _asof(spark, d)
    when = news(spark, d).select("news_id", _us("published_at"))
    return x.join(when, "news_id").groupBy("ticker").agg(F.count_if(F.col("published_at") > F.col("timestamp")).alias("violations"), F.count("*").alias("matched"))


def cache_split(spark, d):
    """Incoming articles whose content was scored with the history, and those to score."""
    h = lambda x: T.content_hash(F.lit(""), F.col("headline"), F.lit(""), F.lit(None).cast("timestamp"))
    old = latest_by(read(spark, d, "news").filter("headline is not null").select(h(None).alias("content_hash"), "news_id"), "content_hash", "news_id").withColumnRenamed("news_id", "scored_as")
    items = read(spark, d, "news_incoming").filter("headline is not null").select("news_id", h(None).alias("content_hash"))
    hit, miss = scored_and_new(items, old)
    return hit.select("news_id", "scored_as", F.lit(True).alias("cached")).unionByName(miss.select("news_id", F.lit(-1).cast("long").alias("scored_as"), F.lit(False).alias("cached")))


def latest_scores(spark, d):
    x = read(spark, d, "news").filter("headline is not null").select(T.fingerprint(F.col("headline")).alias("content_hash"), "news_id", "batch_no")
    return latest_by(x, "content_hash", "news_id").select("content_hash", "news_id")


def breaker_spells(spark, d):
    x = read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return feeds.open_spells(x, by="user_id", at="ts", failed=F.col("event_type") == "error", after=2).select("user_id", _us("opened_at"), _us("closed_at"), "failures")


def news_months(spark, d):
    x = news(spark, d).groupBy("provider").agg(F.min("published_at").alias("a"), F.max("published_at").alias("b"))
    return x.select("provider", F.explode(month_chunks(F.col("a"), F.col("b"))).alias("c")).select("provider", _us("c.chunk_start", "chunk_start"), _us("c.chunk_end", "chunk_end"))


def set_operations(spark, d):
    a = news(spark, d).select("ticker").distinct()
    b = read(spark, d, "documents").select(entity_key(F.col("ticker")).alias("ticker")).filter("ticker is not null").distinct()
    tag = lambda x, n: x.select("ticker", F.lit(n).alias("set"))
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "news only")).unionByName(tag(b.subtract(a), "documents only"))


def events_tumbling(spark, d):
    x = E.tumbling(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return x.select(_us("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def events_sliding(spark, d):
    x = E.sliding(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return x.select(_us("window_start"), "event_type", "n", "top")


def events_sessions(spark, d):
    x = E.sessions(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), gap="6 hours")
    return x.select("user_id", _us("session_start"), _us("session_end"), "n")


def late_rows(spark, d):
    return E.not_late(read(spark, d, "news"), at="published_at", received="ingested_at", hours=24.0).select("news_id")


QUERIES = {
    f.__name__: f
    for f in (
        valid_articles, article_checks, filled_articles, provider_union, provider_histogram, window_filter, newest_first, ticker_mentions, enriched_items, clean_text, clean_headline,
        headline_fingerprint, content_hash, title_source, related_tickers, cache_keys, safe_numbers, json_roundtrip, csv_lines, dedup_url, dedup_similar, dedup_three_pass, jaccard_pairs,
        article_sentiment, batch_scores, signal_reasons, label_histogram, recency_weights, event_clusters, daily_sentiment, rolling_sentiment, quiet_days, peer_strength, asof_sentiment, asof_offset, asof_tolerance, lookahead_audit,
        cache_split, latest_scores, breaker_spells, news_months, set_operations, events_tumbling, events_sliding, events_sessions, late_rows,
    )
}

_BLANK = "length(regexp_replace({c}, '\\s', '', 'g')) > 0"
_N = """WITH n AS (SELECT * EXCLUDE (ticker), CASE WHEN trim(ticker) <> '' THEN upper(trim(ticker)) END AS ticker, epoch_us(published_at) AS us, strftime(timezone('UTC', published_at), '%Y-%m-%d') AS day FROM news)"""
_FILLED = lambda *cs: "coalesce(" + ", ".join(f"CASE WHEN {_BLANK.format(c=c)} THEN {c} END" for c in cs) + ")"
_SET = r"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{{{L}}}}\p{{{{N}}}}_]+'))"
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_KEYWORDS = """lst AS (SELECT DISTINCT ON (ticker) * FROM (SELECT upper(trim(ticker)) AS ticker, sector, lower(split_part(company, ' ', 1)) AS keyword FROM tickers WHERE trim(ticker) <> '')),
peer AS (SELECT sector, list(keyword ORDER BY ticker) AS peers FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY ticker) AS nth FROM lst WHERE sector IS NOT NULL AND keyword IS NOT NULL) WHERE nth <= 11 GROUP BY 1),
kw AS (SELECT ticker, keyword, coalesce(list_slice(list_filter(peers, lambda x: x <> keyword), 1, 10), []) AS competitors FROM lst LEFT JOIN peer USING (sector))"""
_SCORED = f"""{_N}, {_KEYWORDS}, w AS (
  SELECT n.*, t.keyword, t.competitors, regexp_extract_all(lower(concat_ws(' ', headline, snippet)), '[a-z]+') AS ws
  FROM n LEFT JOIN kw t ON t.ticker = n.ticker WHERE n.ticker IS NOT NULL AND {_BLANK.format(c='headline')}
), k AS (SELECT *, len(list_filter(ws, lambda x: list_contains({_LIST(S.POSITIVE_WORDS)}, x))) AS up, len(list_filter(ws, lambda x: list_contains({_LIST(S.NEGATIVE_WORDS)}, x))) AS down FROM w),
s AS (
  SELECT news_id, ticker, day, us, headline, CASE WHEN up > down THEN 'POSITIVE' WHEN up < down THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment,
  CASE WHEN up + down = 0 THEN 0.0 ELSE abs(up - down) * 10.0::DOUBLE / (up + down) END AS conviction, CASE WHEN contains(lower(headline), keyword) THEN 1.0 WHEN len(list_filter(competitors, lambda x: contains(lower(headline), x))) > 0 THEN 0.8 WHEN provider = 'rss' THEN 0.3 ELSE 0.9 END AS relevance FROM k
)"""
_PAIRS = f"""p AS (SELECT news_id, ticker, day, {_SET.format(c='headline')} AS ws FROM {{source}}),
pairs AS (SELECT a.news_id AS a, b.news_id AS b, len(list_intersect(a.ws, b.ws)) AS m, len(a.ws) + len(b.ws) AS t FROM p a JOIN p b ON a.ticker = b.ticker AND {{group}} a.news_id < b.news_id WHERE len(a.ws) > 0 AND len(b.ws) > 0)"""
_CLUSTERS = f"""{_SCORED.replace('WITH n', 'WITH RECURSIVE n')}, sd AS (SELECT * FROM s WHERE day IS NOT NULL), {_PAIRS.format(source='sd', group='a.day = b.day AND')},
edges AS (SELECT a, b FROM pairs WHERE m * 8 >= t * 3 UNION ALL SELECT b, a FROM pairs WHERE m * 8 >= t * 3),
reach AS (SELECT news_id AS a, news_id AS b FROM sd UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
cl AS (SELECT a AS news_id, min(b) AS cluster, count(*) AS cluster_size FROM reach GROUP BY a)"""
_SIGNALS = f"""{_CLUSTERS}, q AS (
  SELECT sd.*, cluster, coalesce(exp(-0.08 * greatest((epoch_us(CAST(day AS TIMESTAMP)) + 86340000000 - us) / 3.6e9, 0.0)), 0.5) * relevance / cluster_size AS wt,
  CASE sentiment WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END AS dir FROM sd JOIN cl USING (news_id)
), g AS (SELECT ticker, day, sum(wt * dir) / sum(wt) AS direction, sum(wt * conviction) / sum(wt) AS c, count(*) AS articles, count(DISTINCT cluster) AS events FROM q GROUP BY 1, 2),
sig AS (SELECT *, CASE WHEN direction > 0.15 THEN 'POSITIVE' WHEN direction < -0.15 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment FROM g),
sign AS (SELECT ticker, day, direction, CASE WHEN sentiment = 'NEUTRAL' THEN least(c, 2.0) ELSE c END AS conviction, sentiment, articles, events FROM sig)"""
_CLOSES = """valid AS (SELECT upper(trim(ticker)) AS ticker, epoch_us("timestamp") AS us, "close" FROM (SELECT *, row_number() OVER (PARTITION BY bar_id ORDER BY ingested_at DESC) AS nth FROM daily_bars) WHERE nth = 1 AND "close" > 0)"""


def _asof_sql(offset_us: int = 0, condition: str = "true") -> str:
    """Of articles at the same time the last counts, so ties are settled before the as-of join."""
    return f"""{_SCORED}, snaps AS (SELECT ticker, us, max(news_id) AS news_id, arg_max(sentiment, news_id) AS sentiment FROM s WHERE us IS NOT NULL GROUP BY 1, 2), {_CLOSES},
b AS (SELECT ticker, us, us - {offset_us} AS cut FROM valid)
SELECT b.ticker, b.us AS "timestamp", coalesce(CASE WHEN {condition} THEN x.news_id END, -1) AS news_id, CASE WHEN {condition} THEN x.sentiment END AS sentiment FROM b ASOF LEFT JOIN snaps x ON b.ticker = x.ticker AND b.cut >= x.us"""


#: Row after row, each kept unless it is like one of its ticker kept before.
_GREEDY = """o AS (SELECT news_id, ticker, ws, row_number() OVER (PARTITION BY ticker ORDER BY news_id) AS rn FROM {source}),
k AS (
  SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[][]) AS kept FROM o
  UNION ALL SELECT ticker, rn + 1, CASE WHEN alike THEN ids ELSE list_append(ids, news_id) END, CASE WHEN alike OR len(ws) = 0 THEN kept ELSE list_append(kept, ws) END
  FROM (SELECT k.*, o.news_id, o.ws, len(list_filter(k.kept, lambda w: len(list_intersect(w, o.ws)) * 37 >= (len(w) + len(o.ws)) * 17)) > 0 AS alike FROM k JOIN o ON o.ticker = k.ticker AND o.rn = k.rn + 1)
) SELECT unnest(ids) AS news_id FROM (SELECT ids FROM k QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY rn DESC) = 1)"""
_WORDED = f"{_N.replace('WITH n', 'WITH RECURSIVE n')}, w AS (SELECT news_id, ticker, url, article_id, {_SET.format(c='headline').format()} AS ws FROM n WHERE ticker IS NOT NULL)"
_FIRST = "SELECT * FROM {source} QUALIFY NOT coalesce({blank}, false) OR row_number() OVER (PARTITION BY ticker, {key} ORDER BY news_id) = 1"

SQL = {
    "valid_articles": f"{_N} SELECT news_id, ticker, provider, coalesce(us, -1) AS published_at FROM n WHERE ticker IS NOT NULL AND {_BLANK.format(c='headline')}",
    "article_checks": f"{_N} SELECT CASE WHEN NOT coalesce({_BLANK.format(c='headline')}, false) THEN 'headline' WHEN NOT coalesce({_BLANK.format(c='url')}, false) THEN 'url' WHEN published_at IS NULL THEN 'published_at' ELSE 'valid' END AS why, count(*) AS n FROM n GROUP BY 1",
    "filled_articles": f"{_N} SELECT news_id, {_FILLED('headline', 'snippet')} AS title, {_FILLED('source', 'provider')} AS source, {_FILLED('url', 'article_id')} AS link, lower(coalesce(language, 'unknown')) AS language FROM n",
    "provider_union": f"""{_N}, enough AS (SELECT ticker FROM n WHERE provider IN ('alpaca', 'fmp', 'finnhub') GROUP BY ticker HAVING count(*) >= 60)
SELECT news_id, ticker, provider, CASE provider WHEN 'alpaca' THEN 0 WHEN 'fmp' THEN 1 WHEN 'finnhub' THEN 2 ELSE 3 END AS provider_priority FROM n
WHERE provider IN ('alpaca', 'fmp', 'finnhub') OR (provider = 'rss' AND ticker NOT IN (SELECT ticker FROM enough WHERE ticker IS NOT NULL))""",
    "provider_histogram": f"{_N} SELECT provider, count(*) AS n, count(DISTINCT ticker) AS tickers FROM n GROUP BY provider",
    "window_filter": f"{_N} SELECT news_id, coalesce(us, -1) AS published_at FROM n WHERE published_at IS NULL OR published_at BETWEEN TIMESTAMPTZ '{START}+00' AND TIMESTAMPTZ '{END}+00'",
    "newest_first": f"{_N} SELECT news_id, us AS published_at FROM n ORDER BY us DESC NULLS LAST, news_id LIMIT 20",
    "ticker_mentions": r"""SELECT upper(trim(ticker)) AS ticker, count(*) AS docs, count(*) FILTER (list_contains(regexp_extract_all(upper(text), '[\p{L}\p{N}_]+'), upper(trim(ticker)))) AS mentioning FROM documents WHERE text IS NOT NULL AND trim(ticker) <> '' GROUP BY 1""",
    "enriched_items": f"{_N} SELECT news_id, substr(concat_ws('. ', CASE WHEN {_BLANK.format(c='headline')} THEN headline END, CASE WHEN {_BLANK.format(c='snippet')} THEN snippet END), 1, 800) AS analysis_text, length(coalesce(snippet, '')) AS snippet_chars FROM n",
    "clean_text": r"""SELECT news_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('<p>See https://x.example/a?b=1 ' || snippet || '</p>  Really?! ...', '<[^>]+>', ' ', 'g'), 'https?://\S+', '', 'g'), '[!?.]+([!?.])', '\1', 'g'), '\s+', ' ', 'g')) AS text FROM news WHERE snippet IS NOT NULL""",
    "headline_fingerprint": r"""SELECT news_id, substr(md5(trim(regexp_replace(regexp_replace(lower(headline), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g'))), 1, 12) AS fingerprint FROM news WHERE headline IS NOT NULL""",
    "content_hash": f"""{_N} SELECT news_id, substr(sha256(coalesce(ticker, '') || '|' || coalesce(headline, '') || '|' || coalesce(snippet, '') || '|' ||
  coalesce(CASE WHEN us % 1000000 = 0 THEN strftime(timezone('UTC', published_at), '%Y-%m-%d %H:%M:%S') ELSE strftime(timezone('UTC', published_at), '%Y-%m-%d %H:%M:%S.%f') END || '+00:00', '')), 1, 16) AS content_hash FROM n""",
    "title_source": "SELECT news_id, coalesce(headline, 'untitled') AS title, source FROM news WHERE source IS NOT NULL",
    "related_tickers": "SELECT related, count(*) AS n FROM (SELECT unnest(related_tickers) AS related FROM news) GROUP BY related",
    "cache_keys": f"{_N} SELECT news_id, translate(concat_ws('_', 'news', ticker, strftime(timezone('UTC', published_at), '%Y-%m-%d %H:%M')), '/: ', '___') AS key FROM n WHERE published_at IS NOT NULL",
    "safe_numbers": """SELECT rec_id, coalesce(try_cast(coalesce(published_at, "timestamp") AS DOUBLE), -1.0) AS as_double, coalesce(CAST(trunc(try_cast(coalesce(published_at, "timestamp") AS DOUBLE)) AS BIGINT), -1) AS as_long FROM raw_feed""",
    "json_roundtrip": f"{_N} SELECT news_id, ticker, headline, coalesce(us // 1000, -1) AS published_ms, coalesce(len(related_tickers), 0) AS related FROM n",
    "dedup_url": f"{_N} SELECT news_id FROM n WHERE NOT coalesce({_BLANK.format(c='url')}, false) UNION ALL SELECT min(news_id) FROM n WHERE {_BLANK.format(c='url')} GROUP BY ticker, url",
    "dedup_similar": f"{_WORDED}, {_GREEDY.format(source='w')}",
    "dedup_three_pass": f"""{_WORDED}, w1 AS ({_FIRST.format(source='w', key='url', blank=_BLANK.format(c='url'))}), w2 AS ({_FIRST.format(source='w1', key='article_id', blank=_BLANK.format(c='article_id'))}), {_GREEDY.format(source='w2')}""",
    "csv_lines": r"""SELECT coalesce(CASE WHEN regexp_matches(ticker, '[,"\n\r]') THEN '"' || replace(ticker, '"', '\"') || '"' ELSE ticker END, '') || ',' || coalesce(CASE WHEN regexp_matches(company, '[,"\n\r]') THEN '"' || replace(company, '"', '\"') || '"' ELSE company END, '') || ',' || coalesce(CASE WHEN regexp_matches(sector, '[,"\n\r]') THEN '"' || replace(sector, '"', '\"') || '"' ELSE sector END, '') AS line FROM tickers""",
    "jaccard_pairs": f"{_N}, {_PAIRS.format(source='n', group='a.day = b.day AND')} SELECT a, b, round(m / (t - m), 6) AS overlap FROM pairs WHERE m * 8 >= t * 3",
    "article_sentiment": f"{_SCORED} SELECT news_id, sentiment, round(conviction, 6) AS conviction, relevance FROM s",
    "batch_scores": f"{_SCORED} SELECT news_id, sentiment, round(conviction, 6) AS conviction, 'words' AS scored_by FROM s",
    "signal_reasons": f"""{_CLUSTERS} SELECT ticker, day, printf('%d positive, %d negative, %d neutral in %d events; most: %s', count(*) FILTER (sentiment = 'POSITIVE'), count(*) FILTER (sentiment = 'NEGATIVE'), count(*) FILTER (sentiment = 'NEUTRAL'),
  count(DISTINCT cluster), substr(arg_max(headline, (conviction, -news_id)), 1, 120)) AS reason FROM sd JOIN cl USING (news_id) GROUP BY ticker, day""",
    "label_histogram": f"{_SCORED} SELECT ticker, count(*) FILTER (sentiment = 'POSITIVE') AS positive, count(*) FILTER (sentiment = 'NEGATIVE') AS negative, count(*) FILTER (sentiment = 'NEUTRAL') AS neutral, arg_max(news_id, (conviction, -news_id)) AS top_article FROM s GROUP BY ticker",
    "recency_weights": f"{_N}, x AS (SELECT news_id, (epoch_us(TIMESTAMPTZ '{END}+00') - us) / 3.6e9 AS age FROM n) SELECT news_id, round(CASE WHEN age IS NULL THEN 0.5 ELSE exp(-0.08 * greatest(age, 0.0)) END, 6) AS weight, round(age, 9) AS age_hours FROM x",
    "event_clusters": f"{_CLUSTERS} SELECT news_id, cluster, cluster_size FROM cl",
    "daily_sentiment": f"{_SIGNALS} SELECT ticker, day, round(direction, 6) AS direction, round(conviction, 6) AS conviction, sentiment, articles, events FROM sign",
    "rolling_sentiment": f"""{_SIGNALS}, y AS (SELECT ticker, day, CASE sentiment WHEN 'POSITIVE' THEN conviction WHEN 'NEGATIVE' THEN -conviction ELSE 0 END AS x, row_number() OVER (PARTITION BY ticker ORDER BY day) - 1 AS k FROM sign)
SELECT ticker, day, round(sum(CASE WHEN k = 0 THEN x ELSE x / 3 * pow(1.5, k) END) OVER (PARTITION BY ticker ORDER BY day ROWS UNBOUNDED PRECEDING) * pow(1.5, -k), 6) AS rolling FROM y""",
    "quiet_days": f"""{_N}, {_CLOSES}, m AS (
  SELECT ticker, strftime(DATE '1970-01-01' + CAST(us // 86400000000 AS INTEGER), '%Y-%m-%d') AS day, "close" / coalesce(lag("close", 5) OVER (PARTITION BY ticker ORDER BY us), first_value("close") OVER (PARTITION BY ticker ORDER BY us)) - 1 AS m FROM valid
) SELECT ticker, day, round(m, 6) AS momentum, CASE WHEN m > 0.02 THEN 'POSITIVE' WHEN m < -0.02 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment FROM m ANTI JOIN n USING (ticker, day)""",
    "peer_strength": f"""{_SIGNALS}, z AS (SELECT *, CASE WHEN sentiment = 'POSITIVE' AND conviction > 5 THEN 1 ELSE 0 END AS strong FROM sign), y AS (SELECT *, sum(strong) OVER (PARTITION BY day) - strong AS peers FROM z)
SELECT ticker, day, CAST(peers AS BIGINT) AS peers, round(conviction * (1 - least(0.25, peers * 0.05)), 6) AS dampened FROM y""",
    "asof_sentiment": _asof_sql(),
    "asof_offset": _asof_sql(6 * 3_600_000_000),
    "asof_tolerance": _asof_sql(0, "b.us - x.us <= 86400000000"),
    "lookahead_audit": f"WITH r AS ({_asof_sql()}) SELECT ticker, CAST(0 AS BIGINT) AS violations, count(*) AS matched FROM r WHERE news_id <> -1 GROUP BY ticker",
    "cache_split": "WITH h AS (SELECT headline, max(news_id) AS scored_as FROM news WHERE headline IS NOT NULL GROUP BY 1) SELECT i.news_id, coalesce(h.scored_as, -1) AS scored_as, h.scored_as IS NOT NULL AS cached FROM news_incoming i LEFT JOIN h USING (headline) WHERE i.headline IS NOT NULL",
    "latest_scores": r"""SELECT substr(md5(trim(regexp_replace(regexp_replace(lower(headline), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g'))), 1, 12) AS content_hash, max(news_id) AS news_id FROM news WHERE headline IS NOT NULL GROUP BY 1""",
    "breaker_spells": """WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_type = 'error' AS f FROM events), r AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM e),
k AS (SELECT user_id, run, us, row_number() OVER (PARTITION BY user_id, run ORDER BY us) AS nth FROM r WHERE f)
SELECT user_id, min(us) FILTER (nth = 2) AS opened_at, max(us) + 120000000 AS closed_at, max(nth) AS failures FROM k GROUP BY user_id, run HAVING max(nth) >= 2""",
    "news_months": f"""{_N}, s AS (SELECT provider, min(us) AS a, max(us) AS b FROM n GROUP BY 1), m AS (SELECT provider, a, b, unnest(generate_series(date_trunc('month', make_timestamp(a)), make_timestamp(b), INTERVAL 1 MONTH)) AS m FROM s)
SELECT provider, greatest(epoch_us(m), a) AS chunk_start, least(epoch_us(m + INTERVAL 1 MONTH), b) AS chunk_end FROM m WHERE greatest(epoch_us(m), a) < least(epoch_us(m + INTERVAL 1 MONTH), b)""",
    "set_operations": f"""{_N}, a AS (SELECT DISTINCT ticker FROM n), b AS (SELECT DISTINCT upper(trim(ticker)) AS ticker FROM documents WHERE trim(ticker) <> '')
SELECT ticker, 'both' AS "set" FROM (SELECT ticker FROM a INTERSECT SELECT ticker FROM b) UNION ALL SELECT ticker, 'news only' FROM (SELECT ticker FROM a EXCEPT SELECT ticker FROM b) UNION ALL SELECT ticker, 'documents only' FROM (SELECT ticker FROM b EXCEPT SELECT ticker FROM a)""",
    "events_tumbling": "SELECT epoch_us(date_trunc('day', ts)) AS window_start, event_type, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(20,4))), 4) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "events_sliding": """SELECT epoch_us(w) AS window_start, event_type, count(*) AS n, max(value) AS top FROM (SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM events) GROUP BY 1, 2""",
    "events_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS new_ FROM events), s AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(us) AS session_start, max(us) + 21600000000 AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
    "late_rows": "SELECT news_id FROM news WHERE published_at IS NULL OR (epoch_us(ingested_at) - epoch_us(published_at)) / 3.6e9 <= 24.0",
}
