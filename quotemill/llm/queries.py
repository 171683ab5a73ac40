"""Queries of the problems for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.bpe import count_tokens, encode_column
from quotemill.llm.mixing import mix_sources
from quotemill.llm.nearest import nearest
from quotemill.llm.residue import residue_marks
from quotemill.llm.segment_index import SegmentIndex, accept_batches
from quotemill.llm.vptree import classes, expanded_pairs, near_duplicates
from quotemill.operators.deliveries import latest_deliveries
from quotemill.session import broadcast_within, cut, read, remove, shared_folder


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all news is written once; the batches are then taken one after the other, each against what is stored by then."""
    path = shared_folder(spark, "segment-index")
    index = SegmentIndex.build(read(spark, sf_dir, "news"), path)
    found = accept_batches(index, read(spark, sf_dir, "news_incoming"))
    remove(spark, path)
    return found.select("news_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_duplicates(read(spark, sf_dir, "news"))
    return expanded_pairs(members, links)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(*near_duplicates(read(spark, sf_dir, "news")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = latest_deliveries(read(spark, sf_dir, "intraday_bars").select("bar_id", "ticker", "timestamp", "ingested_at"))
    return nearest(read(spark, sf_dir, "news"), bars).select("news_id", "bar_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(read(spark, sf_dir, "documents"))


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[1]


def p9_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares when as many tokens are asked for as the listed sources hold: small sources run out."""
    documents, targets = read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets")
    sizes = cut(count_tokens(documents.select("doc_id", "source", "text").join(broadcast_within(targets.select("source"), 10_000), "source", "left_semi")))
    return mix_sources(documents, targets, token_counts=sizes, budget=int(sizes.agg(F.sum("n_tokens")).first()[0] or 0))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_marks(read(spark, sf_dir, "documents")).filter("residue").select("doc_id")


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains once residue is excluded."""
    documents = read(spark, sf_dir, "documents")
    marks = residue_marks(documents).filter("residue").select(F.col("doc_id").alias("__out"))
    return documents.join(marks, documents["doc_id"] == F.col("__out"), "left_anti").select("doc_id", "source", "lang", "n_chars")


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p8_lengths": p8_lengths,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_all": p9_all,
    "p10_found": p10_found,
    "p10_kept": p10_kept,
}

_WORDS = r"list_distinct(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'))"

SQL = {
    "p3_found": f"""WITH sets AS (
  SELECT news_id, {_WORDS.format(text="headline || ' ' || snippet")} AS ws FROM news
  WHERE length(regexp_replace(headline, '\\s', '', 'g')) > 0 AND length(regexp_replace(snippet, '\\s', '', 'g')) > 0
), near AS (
  SELECT a.news_id AS news_id_a, b.news_id AS news_id_b, len(list_intersect(a.ws, b.ws)) AS common, len(a.ws) AS na, len(b.ws) AS nb
  FROM sets a JOIN sets b ON a.news_id < b.news_id AND len(a.ws) * 20 >= len(b.ws) * 13 AND len(b.ws) * 20 >= len(a.ws) * 13
) SELECT news_id_a, news_id_b FROM near WHERE common * 33 >= (na + nb) * 13""",
    "p3_classes": f"""WITH rows_ AS (
  SELECT news_id, list_sort({_WORDS.format(text="headline || ' ' || snippet")}) AS ws FROM news
  WHERE length(regexp_replace(headline, '\\s', '', 'g')) > 0 AND length(regexp_replace(snippet, '\\s', '', 'g')) > 0
), sets AS (SELECT ws, min(news_id) AS class_id, count(*) AS class_size FROM rows_ WHERE len(ws) > 0 GROUP BY ws),
near AS (
  SELECT a.class_id, count(*) AS links FROM sets a JOIN sets b ON a.class_id <> b.class_id AND len(a.ws) * 20 >= len(b.ws) * 13 AND len(b.ws) * 20 >= len(a.ws) * 13
  WHERE len(list_intersect(a.ws, b.ws)) * 33 >= (len(a.ws) + len(b.ws)) * 13 GROUP BY 1
) SELECT news_id, class_id, class_size, coalesce(links, 0) AS links FROM rows_ JOIN sets USING (ws) LEFT JOIN near USING (class_id)""",
    "p7_found": """WITH valid AS (
  SELECT bar_id, upper(trim(ticker)) AS tk, epoch_us("timestamp") AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY bar_id ORDER BY ingested_at DESC) AS nth FROM intraday_bars) WHERE nth = 1
), readings AS (SELECT tk, t, min(bar_id) AS bar_id FROM valid GROUP BY 1, 2),
articles AS (SELECT news_id, upper(trim(ticker)) AS tk, epoch_us(published_at) AS t FROM news WHERE published_at IS NOT NULL),
before AS (SELECT n.news_id, n.t, r.bar_id AS bar_b, r.t AS tb FROM articles n ASOF LEFT JOIN readings r ON n.tk = r.tk AND n.t >= r.t),
after AS (SELECT n.news_id, r.bar_id AS bar_a, r.t AS ta FROM articles n ASOF LEFT JOIN readings r ON n.tk = r.tk AND n.t <= r.t),
gaps AS (SELECT news_id, bar_b, bar_a, t - tb AS gb, ta - t AS ga FROM before JOIN after USING (news_id))
SELECT news_id, CASE WHEN ga IS NULL OR gb <= ga THEN bar_b ELSE bar_a END AS bar_id FROM gaps WHERE least(gb, ga) <= 600000000""",
}
