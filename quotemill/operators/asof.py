"""As-of joins: the latest record at or before a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.columns import floor_div


def asof_join(left: DataFrame, right: DataFrame, *, by: str, left_at: str, right_at: str, right_order: Sequence[str] = (), offset_seconds: float = 0, tolerance_seconds: float | None = None, suffix: str = "_asof", span_days: int = 32) -> DataFrame:
    """left with the columns of the latest right record of the same key whose time is at most left's minus the offset; null if there is none or it is older than the tolerance.

    Of several right records at that time the last by right_order counts. Both sides are
    merged into one stream, sorted by time, and the last right record is carried forward;
    no pairs are formed. Keys are cut into spans of time: what a span needs from before
    it is the last record of each earlier span that has any, one row per key and span, so
    a busy key spreads over all its spans. Null keys and times match nothing. Right
    columns get the suffix where their names clash.
    """
    width = span_days * 86_400_000_000
    clash = set(left.columns)
    names = {c: c + suffix if c in clash else c for c in right.columns}
    age = F.unix_micros(F.col(left_at)) - int(offset_seconds * 1_000_000)
    key = F.col(by)
    payload = F.struct(*[F.col(c) for c in right.columns])
    order = F.struct(*[F.col(c) for c in right_order]) if right_order else F.struct(F.lit(0))
    ls = left.select(key.alias("__k"), age.alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(dict(right.select(order.alias("o")).dtypes)["o"]).alias("__o"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(payload.alias("p")).dtypes[0][1]).alias("__r"))
    rs = right.filter(key.isNotNull() & F.col(right_at).isNotNull()).select(key.alias("__k"), F.unix_micros(F.col(right_at)).alias("__t"), F.lit(0).alias("__side"), order.alias("__o"), F.lit(None).cast(dict(ls.dtypes)["__l"]).alias("__l"), payload.alias("__r"))
    spans = lambda df: df.withColumn("__s", floor_div(F.col("__t"), width))
    ls, rs = spans(ls), spans(rs)
    # The last right record of each span stands for it in the search for the one before a span.
    lasts = rs.groupBy("__k", "__s").agg(F.max_by("__r", F.struct("__t", "__o")).alias("__last"), F.max("__t").alias("__lt"))
    wanted = ls.select("__k", "__s").distinct().withColumns({"__last": F.lit(None).cast(dict(lasts.dtypes)["__last"]), "__lt": F.lit(None).cast("long")}).withColumn("__want", F.lit(True))
    carried = (
        lasts.withColumn("__want", F.lit(False))
        .unionByName(wanted)
        .groupBy("__k", "__s")
        .agg(F.max_by("__last", "__lt").alias("__last"), F.max("__lt").alias("__lt"), F.max("__want").alias("__want"))
    )
    earlier = Window.partitionBy("__k").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("__k", "__s", "__want", F.last("__last", True).over(earlier).alias("__r"), F.last("__lt", True).over(earlier).alias("__t")).filter("__want and __r is not null")
    seeds = carried.select("__k", "__t", F.lit(0).alias("__side"), F.lit(None).cast(dict(ls.dtypes)["__o"]).alias("__o"), F.lit(None).cast(dict(ls.dtypes)["__l"]).alias("__l"), "__r", "__s")
    stream = Window.partitionBy("__k", "__s").orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    found = ls.unionByName(rs).unionByName(seeds).withColumn("__r", F.when(F.col("__k").isNotNull() & F.col("__t").isNotNull(), F.last("__r", True).over(stream))).filter("__side = 1")
    if tolerance_seconds is not None:
        found = found.withColumn("__r", F.when(F.col("__t") - F.unix_micros(F.col("__r")[right_at]) <= int(tolerance_seconds * 1_000_000), F.col("__r")))
    return found.select("__l.*", *[F.col("__r")[c].alias(n) for c, n in names.items() if c != by])
