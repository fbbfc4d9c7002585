"""Ranking: fusion of lists, tiered selection, fair shares, budgets. All are windows over the caller's keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S
from ..functions import values as V


def ranked(hits: DataFrame, keys: Sequence[str], item: str, score: str, pos: str) -> DataFrame:
    """Rank within each list (keys): best first, only the best place of an item counts."""
    first = hits.groupBy(*keys, item).agg(F.max_by(F.struct(score, pos), F.struct(F.col(score).alias("s"), (-F.col(pos)).alias("p"))).alias("b")).select(*keys, item, f"b.{score}", f"b.{pos}")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc(), pos)))


def rrf(lists: DataFrame, query: Sequence[str], item: str, k: int = S.RRF_K) -> DataFrame:
    """(query, item, rrf): the sum over lists of 1 / (k + rank)."""
    return lists.groupBy(*query, item).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("rrf"))


def workspace_priority(source_in: Column, target_in: Column, outside_is_company: Column) -> Column:
    """0 within the workspace, 1 to a company outside, 2 to anything else outside, 3 unrelated."""
    return F.when(source_in & target_in, 0).when(~source_in & ~target_in, 3).when(outside_is_company, 1).otherwise(2)


def event_order(types: Sequence[str], *, risk_wanted: bool, since: str | None, similarity: str = "similarity") -> list[Column]:
    """The sort of events for a question: type, risk and recency if asked for, likeness by bucket, risk, date, id."""
    order = [F.when(F.col("event_type").isin(*types), 0).otherwise(1)] if types else []
    order += [F.when(F.col("is_risk"), 0).otherwise(1)] if risk_wanted else []
    order += [F.when(F.coalesce("occurred_at", F.lit("")) >= since, 0).otherwise(1)] if since else []
    return [*order, V.bucket(F.col(similarity)).desc(), F.when(F.col("is_risk"), 0).otherwise(1), F.coalesce("occurred_at", F.lit("")).desc(), F.col("event_id")]


def interleave(df: DataFrame, keys: Sequence[str], tier: str, side: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """Within limit seats per keys, the two sides of each tier take turns, side first; tiers fill in order.

    Seat numbers in closed form: the k-th of side takes turn 2k - 1, the k-th other 2k; ranking by turn closes the gaps
    that a shorter side leaves. Rows past the limit on their own side have no seat and go before the second window.
    """
    d = df.withColumn("_side", F.when(side, 0).otherwise(1))
    d = d.withColumn("_k", F.row_number().over(W.partitionBy(*keys, tier, "_side").orderBy(*order))).where(F.col("_k") <= limit)
    seat = F.row_number().over(W.partitionBy(*keys).orderBy(tier, 2 * F.col("_k") + F.col("_side"), *order))
    return d.withColumn("seat", seat).where(F.col("seat") <= limit).drop("_side", "_k")


def turns(df: DataFrame, keys: Sequence[str], kind: str, order: Sequence[Column], budget: int) -> DataFrame:
    """Round robin over kinds within keys: the first of each kind, then the second, until the budget is spent."""
    d = df.withColumn("turn", F.row_number().over(W.partitionBy(*keys, kind).orderBy(*order))).where(F.col("turn") <= budget)
    return d.withColumn("seat", F.row_number().over(W.partitionBy(*keys).orderBy("turn", kind))).where(F.col("seat") <= budget)


def floor_then_cap(df: DataFrame, key: str, kind: str, order: Sequence[Column], floor: int, cap: int) -> DataFrame:
    """First `floor` of every kind, then the best of the rest, up to cap per key."""
    d = df.withColumn("_k", F.row_number().over(W.partitionBy(key, kind).orderBy(*order))).where(F.col("_k") <= cap)
    d = d.withColumn("seat", F.row_number().over(W.partitionBy(key).orderBy(F.when(F.col("_k") <= floor, 0).otherwise(1), *order)))
    return d.where(F.col("seat") <= cap).drop("_k")


def thin(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """n rows of each key at even steps through their order; all of a key with no more than n."""
    w = W.partitionBy(key)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # row i is kept if it is floor(j * size / n) for some j
    j = F.ceil(F.col("_i") * n / F.col("_n"))
    return d.where((F.col("_n") <= n) | (F.floor(j * F.col("_n") / n) == F.col("_i"))).drop("_i", "_n")
