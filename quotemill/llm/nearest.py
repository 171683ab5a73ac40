"""Pairing records of two tables by nearest time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.columns import entity_key, floor_div
from quotemill.session import ship


class _Merge:
    """Two-pointer merge over a sorted stream of records of both tables.

    A record is (entity, span, time, side, key), side 0 for right ones, in this order; of
    right records at one time only the first counts. What is kept between batches are the
    last right record and the left ones after it that a later right record could still
    be nearest to.
    """

    def __init__(self, tolerance: int):
        self.tolerance = tolerance
        self.kept: pa.Table | None = None

    def feed(self, batch: pa.Table | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left and right keys and the time between them, of the left records that are settled; None ends the stream."""
        parts = [x for x in (self.kept, batch) if x is not None and len(x)]
        self.kept = None
        if not parts:
            return (np.empty(0, np.int64),) * 3
        t = pa.concat_tables(parts).combine_chunks()
        n = len(t)
        time, side, key = t["t"].to_numpy(), t["side"].to_numpy(), t["k"].to_numpy()
        new = np.ones(n, dtype=bool)
        if n > 1:
            differs = pc.or_(pc.not_equal(t["e"][1:], t["e"][:-1]), pc.not_equal(t["span"][1:], t["span"][:-1]))
            new[1:] = differs.to_numpy(zero_copy_only=False)
        group = np.cumsum(new)
        right = side == 0
        again = np.zeros(n, dtype=bool)
        again[1:] = right[1:] & right[:-1] & ~new[1:] & (time[1:] == time[:-1])
        right &= ~again
        i = np.arange(n)
        before = np.maximum.accumulate(np.where(right, i, -1))
        after = np.minimum.accumulate(np.where(right, i, n)[::-1])[::-1]
        has_before = (before >= 0) & (group[np.maximum(before, 0)] == group)
        has_after = (after < n) & (group[np.minimum(after, n - 1)] == group)
        far = np.iinfo(np.int64).max
        gap_b = np.where(has_before, time - time[np.maximum(before, 0)], far)
        gap_a = np.where(has_after, time[np.minimum(after, n - 1)] - time, far)
        left = side == 1
        ended = np.zeros(n, dtype=bool) if batch is not None else np.ones(n, dtype=bool)
        settled = ended | has_after | (group < group[-1]) | (time[-1] - time > self.tolerance)
        if batch is not None:
            stay = (left & ~settled) | ((i == before[-1]) & has_before[-1])
            self.kept = t.filter(pa.array(stay))
        use = np.where(gap_b <= gap_a, before, after)
        gap = np.minimum(gap_b, gap_a)
        hit = left & settled & (gap <= self.tolerance)
        at = use[hit]
        return key[hit], key[at], time[at] - time[hit]


def nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    left_key: str = "news_id",
    left_entity: str = "ticker",
    left_at: str = "published_at",
    right_key: str = "bar_id",
    right_entity: str = "ticker",
    right_at: str = "timestamp",
    tolerance_seconds: float = 600,
    span_seconds: float = 7200,
) -> DataFrame:
    """left_key, right_key, offset_us (right time minus left time): for each left record the right record of its entity nearest in time, if at most the tolerance away.

    Of two equally near records the earlier one, of several at the same time the one with
    the least key. Times are compared in microseconds. Both tables are repartitioned by
    entity and span of time and sorted within partitions; a right record within the
    tolerance of the next span is sent there too, so that a busy entity spreads over all
    its spans. One pass per partition merges both sides and holds only neighbouring right
    records and the left ones between them.

    Keys are longs. Records with a null key, a null or blank entity or a null time pair with
    nothing and are not returned, nor are left records without a partner. Repeated left
    rows each get their pair; repeated right rows count once. Empty tables give no rows;
    extra columns are ignored, whatever their names.
    """
    ship(left.sparkSession)
    tol, span = int(tolerance_seconds * 1_000_000), int(span_seconds * 1_000_000)
    one = lambda df, k, e, t: df.select(F.col(k).cast("long").alias("k"), entity_key(F.col(e)).alias("e"), F.unix_micros(F.col(t)).alias("t")).filter("k is not null and e is not null and t is not null")
    lefts = one(left, left_key, left_entity, left_at).withColumn("span", floor_div(F.col("t"), span)).withColumn("side", F.lit(1).cast("byte"))
    rights = one(right, right_key, right_entity, right_at).withColumn("span", F.explode(F.sequence(floor_div(F.col("t") - tol, span), floor_div(F.col("t") + tol, span)))).withColumn("side", F.lit(0).cast("byte"))
    both = lefts.select("e", "span", "t", "side", "k").unionByName(rights.select("e", "span", "t", "side", "k"))
    ordered = both.repartition("e", "span").sortWithinPartitions("e", "span", "t", "side", "k")

    def merge(batches):
        m = _Merge(tol)
        for b in batches:
            if b.num_rows:
                yield _pairs(m.feed(pa.Table.from_batches([b])))
        yield _pairs(m.feed(None))

    out = ordered.mapInArrow(merge, "l long, r long, d long")
    return out.select(F.col("l").alias(left_key), F.col("r").alias(right_key), F.col("d").alias("offset_us"))


def _pairs(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=pa.int64()) for v in x], names=["l", "r", "d"])
