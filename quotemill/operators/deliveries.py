"""Rows that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_deliveries(df: DataFrame, key: str = "bar_id", at: str = "ingested_at") -> DataFrame:
    """The valid row of each key: the delivery with the latest `at`.

    Null `at` counts as earliest. Deliveries with the same `at` are told apart by their
    other columns in order (largest first), so the choice doesn't depend on partitions.
    Rows with a null key can't be matched with each other; only whole repeats of them
    collapse. One shuffle on the key; every group is as small as one key's deliveries.
    """
    others = [c for c, kind in df.dtypes if c not in (key, at) and not kind.startswith("map")]
    loose = F.when(F.col(key).isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in [at, *others]]))
    w = Window.partitionBy(F.col(key), loose).orderBy(F.col(at).desc_nulls_last(), *[F.col(f"`{c}`").desc_nulls_last() for c in others])
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")
