"""Removal of repeated articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.columns import blank_to_null
from quotemill.functions.text import word_set
from quotemill.operators.similar import first_come, similar_pairs


def first_by_key(df: DataFrame, key: str, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The first row of each key; rows whose key is null or blank all stay, spread over the partitions by their order."""
    k = blank_to_null(F.col(key))
    w = Window.partitionBy(*within, k, F.when(k.isNull(), F.xxhash64(*order))).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n").eqNullSafe(1) | blank_to_null(F.col(key)).isNull()).drop("__n")


def first_of_similar(df: DataFrame, *, key: str, text: str, similarity: float = 0.85, within: tuple[str, ...] = ()) -> DataFrame:
    """df without the rows whose text is similar to that of an earlier row (by key) that stays; rows without words, or without a key, all stay."""
    rows = df.withColumn("__words", word_set(F.coalesce(F.col(text), F.lit(""))))
    pairs = similar_pairs(rows, key=key, words="__words", similarity=similarity, within=within)
    return df.join(first_come(df, pairs, key=key).filter("not kept").select(key), key, "left_anti")


def distinct_articles(df: DataFrame, *, key: str = "news_id", within: tuple[str, ...] = ("ticker",), similarity: float = 0.85) -> DataFrame:
    """Three passes, each over what the one before left: url, article_id, similar headline; the first by key stays."""
    x = first_by_key(df, "url", [key], within)
    x = first_by_key(x, "article_id", [key], within)
    return first_of_similar(x, key=key, text="headline", similarity=similarity, within=within)
