"""From articles to signals of tickers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.numeric import clamp, direction, label_of
from quotemill.functions.text import word_set
from quotemill.functions.time import hours_between
from quotemill.operators.similar import components, similar_pairs
from quotemill.session import cut, ship

DECAY = 0.08  # per hour
CLUSTER = 0.6
THRESHOLD = 0.15
NEUTRAL_CAP = 2.0
UNKNOWN_AGE_WEIGHT = 0.5

POSITIVE_WORDS = ("approves", "beats", "cheered", "climb", "gain", "gains", "higher", "improved", "names", "raises", "rise", "rises", "rose", "surge", "up", "welcomed", "wins")
NEGATIVE_WORDS = ("cuts", "delays", "down", "drop", "fall", "falls", "fell", "fragile", "inquiry", "leave", "loss", "lower", "misses", "narrow", "recall", "slips", "warns")


class Scorer(Protocol):
    """Scores batches of texts; loaded once per worker."""

    name: str

    def available(self) -> bool: ...

    def score(self, texts: pd.Series) -> pd.DataFrame:
        """Columns sentiment (string) and conviction (0 to 10)."""
        ...


def score_with(df: DataFrame, scorers: list[Scorer], text: str = "analysis_text", batch: int = 16, required: bool = False) -> DataFrame:
    """df with sentiment, conviction and scored_by, in batches; raises if no scorer is available.

    Each batch goes to the first available scorer; if that fails, to the next ones, and if
    all fail its texts go through the scorers one by one. scored_by names the scorer of the
    row. Texts that every scorer fails on get nulls and the first one's name, or raise if
    scores are required.
    """
    usable = [s for s in scorers if s.available()]
    if not usable:
        raise RuntimeError("no scorer is available: " + ", ".join(s.name for s in scorers))
    ship(df.sparkSession)

    @F.pandas_udf("sentiment string, conviction double, scored_by string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [_scored(usable, part.iloc[k : k + batch], required) for k in range(0, len(part), batch)]
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"sentiment": [], "conviction": [], "scored_by": []})

    return df.withColumn("__s", run(F.col(text))).select(*df.columns, "__s.*")


def _scored(scorers: list[Scorer], piece: pd.Series, required: bool) -> pd.DataFrame:
    failures = []
    for s in scorers:
        try:
            out = s.score(piece)[["sentiment", "conviction"]]
            if len(out) != len(piece):
                raise ValueError(f"{len(out)} scores for {len(piece)} texts")
            return out.assign(scored_by=s.name)
        except Exception as e:  # noqa: BLE001
            failures.append(f"{s.name}: {e!r}")
    if len(piece) > 1:
        return pd.concat([_scored(scorers, piece.iloc[k : k + 1], required) for k in range(len(piece))], ignore_index=True)
    if required:
        raise RuntimeError("every scorer failed: " + " | ".join(failures))
    return pd.DataFrame({"sentiment": [None], "conviction": [None], "scored_by": [scorers[0].name]})


def _listed(text: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_count(text, F.lit("(?<![a-z])(?:" + "|".join(words) + ")(?![a-z])"))


def with_lexicon_scores(df: DataFrame, text: Column) -> DataFrame:
    """df with sentiment and conviction of a text by counting words; the scorer that needs no model and stays in the JVM."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Columns of their own, so that each is counted once.
    counted = df.withColumn("__low", low).withColumns({"__up": _listed(F.col("__low"), POSITIVE_WORDS), "__down": _listed(F.col("__low"), NEGATIVE_WORDS)})
    up, down = F.col("__up"), F.col("__down")
    conviction = clamp(F.abs(up - down) * 10.0 / F.nullif(up + down, F.lit(0)), 0.0, 10.0)
    return counted.withColumns({"sentiment": label_of((up - down).cast("double"), 0.0), "conviction": F.coalesce(conviction, F.lit(0.0))}).drop("__low", "__up", "__down")


class WordScorer:
    """with_lexicon_scores as a Scorer, for use behind or instead of a model."""

    name = "words"

    def available(self) -> bool:
        return True

    def score(self, texts: pd.Series) -> pd.DataFrame:
        words = texts.fillna("").str.lower().str.findall("[a-z]+")
        up, down = (words.map(lambda ws, listed=frozenset(x): sum(w in listed for w in ws)) for x in (POSITIVE_WORDS, NEGATIVE_WORDS))
        label = (up - down).map(lambda d: "POSITIVE" if d > 0 else "NEGATIVE" if d < 0 else "NEUTRAL")
        return pd.DataFrame({"sentiment": label.to_list(), "conviction": (abs(up - down) * 10.0 / (up + down).where(up + down > 0, 1)).to_list()})


def recency_weight(published: Column, reference: Column, decay: float = DECAY) -> Column:
    age = F.when(published.isNotNull(), F.greatest(hours_between(reference, published), F.lit(0.0)))
    return F.coalesce(F.exp(-age * decay), F.lit(UNKNOWN_AGE_WEIGHT))


def event_clusters(articles: DataFrame, *, key: str = "news_id", text: str = "headline", within: tuple[str, ...] = ("ticker", "day"), similarity: float = CLUSTER) -> DataFrame:
    """articles with cluster (least key of the event) and cluster_size: events are what chains of similar headlines connect within a group."""
    # Used for the pairs, the nodes and the result.
    articles = cut(articles)
    rows = articles.withColumn("__words", word_set(F.coalesce(F.col(text), F.lit(""))))
    found = components(articles, similar_pairs(rows, key=key, words="__words", similarity=similarity, within=within), key=key)
    sizes = found.groupBy("component").agg(F.count("*").alias("cluster_size"))
    return articles.join(found.join(sizes, "component").select(key, F.col("component").alias("cluster"), "cluster_size"), key)


def ticker_signals(articles: DataFrame, *, by: tuple[str, ...] = ("ticker", "day"), reference: Column, decay: float = DECAY, threshold: float = THRESHOLD) -> DataFrame:
    """One signal per group from articles with sentiment, conviction, published_at, relevance and cluster_size: weights fall with age, and an event counts once however many articles report it.

    Columns: by, direction, conviction, sentiment, articles, events, positive, negative, neutral.
    """
    w = recency_weight(F.col("published_at"), reference, decay) * F.col("relevance") / F.col("cluster_size")
    rows = articles.filter("sentiment in ('POSITIVE', 'NEGATIVE', 'NEUTRAL') and conviction between 0 and 10").withColumns({"__w": w, "__d": direction(F.col("sentiment"))})
    total = F.nullif(F.sum("__w"), F.lit(0.0))
    g = rows.groupBy(*by).agg(
        (F.sum(F.col("__w") * F.col("__d")) / total).alias("direction"),
        (F.sum(F.col("__w") * clamp(F.col("conviction"), 0.0, 10.0)) / total).alias("__c"),
        F.count("*").alias("articles"),
        F.countDistinct("cluster").alias("events"),
        *[F.count_if(F.col("sentiment") == s).alias(s.lower()) for s in ("POSITIVE", "NEGATIVE", "NEUTRAL")],
    )
    label = label_of(F.col("direction"), threshold)
    return g.select(*by, "direction", F.when(label == "NEUTRAL", F.least("__c", F.lit(NEUTRAL_CAP))).otherwise(F.col("__c")).alias("conviction"), label.alias("sentiment"), "articles", "events", "positive", "negative", "neutral")
