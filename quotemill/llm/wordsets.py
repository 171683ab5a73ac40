"""Word sets of texts as arrays of 64-bit hashes, in an order that puts rare words first."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Buckets of the word counts that order words: 2^17 numbers, whatever the size of the corpus.
COUNT_BITS = 17


def word_hashes(text: Column) -> Column:
    """The set of maximal runs of letters and digits of a text, lower-cased, as array<long>; empty for null."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))


def set_id(words: Column, seed: int = 0) -> Column:
    """One id for equal word sets, given as sorted arrays."""
    return F.xxhash64(F.lit(seed), words)


def wide_set_id(words: Column) -> Column:
    """One id of 128 bits for equal word sets, where ids are kept and can't be drawn again."""
    w = F.array_sort(words)
    return F.struct(F.xxhash64(w).alias("a"), F.xxhash64(F.lit("second"), w).alias("b"))


def shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap_at_least(shared_words: Column, len_a: Column, len_b: Column, least: Fraction) -> Column:
    """Shared words divided by all words of both >= least, in whole numbers."""
    p, q = least.numerator, least.denominator
    return shared_words * (p + q) >= (len_a + len_b) * p


def as_fraction(similarity: float) -> Fraction:
    return Fraction(similarity).limit_denominator(10_000)


def bucket_counts(sets: DataFrame, words: str = "words") -> np.ndarray:
    """How often words of each hash bucket occur in all sets. Any fixed order of words gives the right pairs; this one makes them cheap to find. Counted in full, combined before the shuffle, and of one size for every corpus."""
    size = 1 << COUNT_BITS

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            total += np.bincount(flat(b.column(0))[0] & (size - 1), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])

    rows = sets.select(words).mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    # They only order words and size shards, so that numbers beyond 32 bits are as good as the largest of these.
    counts = np.zeros(size, dtype=np.int32)
    counts[rows["b"].to_numpy()] = np.minimum(rows["n"].to_numpy(), np.iinfo(np.int32).max)
    return counts


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the number of them in each row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), lengths


def rare_first(values: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row sorted by (count of their bucket, hash): the words, their row, their position in it, and their counts."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    c = counts[values & ((1 << COUNT_BITS) - 1)]
    starts = np.cumsum(lengths) - lengths
    order = np.arange(len(values))
    # Rows of one length at a time are a matrix, of which each row is sorted by itself.
    for n in np.unique(lengths[lengths > 1]):
        at = np.add.outer(starts[lengths == n], np.arange(n))
        by_value = np.argsort(values[at], axis=1)
        at = np.take_along_axis(at, by_value, axis=1)
        by_count = np.argsort(c[at], axis=1, kind="stable")
        order[np.add.outer(starts[lengths == n], np.arange(n))] = np.take_along_axis(at, by_count, axis=1)
    return values[order], row, np.arange(len(values)) - np.repeat(starts, lengths), c[order]
