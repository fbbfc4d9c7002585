"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than one in so many of all rows, and more than LEAST.
SHARE, LEAST = 1000, 10_000


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row per key.

    Rows of hot keys meet their row of right by broadcast: there are fewer than SHARE such keys, so as many rows. All
    others are shuffled. Counting the keys of left is a pass of its own, of which only sums are shuffled.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = [r[0] for r in counts.where((F.col("_n") > max(total // SHARE, LEAST)) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    first = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return first.unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))
