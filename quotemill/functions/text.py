"""Text expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quotemill.functions.columns import blank_to_null

WORD = r"[\p{L}\p{N}_]+"


@F.pandas_udf(StringType())
def compatibility_form(col: pd.Series) -> pd.Series:
    """Unicode NFKD; Spark has no built-in for it."""
    return col.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def one_line(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_headline(c: Column) -> Column:
    return one_line(compatibility_form(c))


def without_markup(c: Column) -> Column:
    """Tags as blanks, web addresses dropped, runs of !, ? and . as their last character, white space evened out."""
    x = F.regexp_replace(c, r"<[^>]+>", " ")
    x = F.regexp_replace(x, r"https?://\S+", "")
    return one_line(F.regexp_replace(x, r"[!?.]+([!?.])", "$1"))


def clean_text(c: Column) -> Column:
    return without_markup(compatibility_form(c))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def word_set(c: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word arrays: 1 for two empty ones, 0 for one."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprint(headline: Column) -> Column:
    """First 12 hex digits of the MD5 of the headline's plain letters, digits and blanks."""
    kept = one_line(F.regexp_replace(F.lower(headline), "[^a-z0-9 ]", ""))
    return F.substring(F.md5(kept), 1, 12)


def content_hash(ticker: Column, headline: Column, snippet: Column, published_at: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the four parts joined by bars; a time without fraction is written without one."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    whole = F.pmod(F.unix_micros(published_at), F.lit(1_000_000)) == 0
    at = F.when(whole, F.date_format(published_at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(published_at, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    joined = F.concat(empty(ticker), F.lit("|"), empty(headline), F.lit("|"), empty(snippet), F.lit("|"), F.when(published_at.isNull(), "").otherwise(F.concat(at, F.lit("+00:00"))))
    return F.substring(F.sha2(joined, 256), 1, 16)


def title_and_source(title: Column) -> tuple[Column, Column]:
    """Title and source of 'title - source', split at the last ' - '; the whole and null without one."""
    has = title.rlike(r" - [^-]*\S[^-]*$|^.* - .*$")
    return F.when(has, F.regexp_extract(title, r"^(.*) - (.*)$", 1)).otherwise(title), F.when(has, F.regexp_extract(title, r"^(.*) - (.*)$", 2))


def mentions(text: Column, ticker: Column) -> Column:
    """Whether the ticker stands in the text as a word."""
    words = F.regexp_extract_all(F.upper(text), F.lit(WORD), F.lit(0))
    return F.array_contains(words, F.upper(F.trim(ticker)))


def analysis_text(headline: Column, snippet: Column, length: int = 800) -> Column:
    return F.substring(F.concat_ws(". ", blank_to_null(headline), blank_to_null(snippet)), 1, length)


def first_filled(*cols: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def cache_key(*parts: Column) -> Column:
    """Parts joined by underscores, with characters that don't belong in file names replaced."""
    return F.translate(F.concat_ws("_", *parts), "/: ", "___")
