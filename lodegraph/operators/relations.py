"""Relations of companies: freshness- and verdict-aware, one hop, by type, best first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S
from ..functions import edges as E


def scored(edges: DataFrame, today: str) -> DataFrame:
    """edges with status, reason, days_since, factor, verdict and score; one projection, no shuffle."""
    e = edges.withColumns(E.assess(today)).withColumn("verdict", E.verdict())
    return e.withColumn("score", E.score())


def relations(edges: DataFrame, today: str, *, types: Sequence[str] | None = None, hide: Sequence[str] = S.HIDDEN_VERDICTS, exclude_status: Sequence[str] = ("expired",), min_score: float = 0.0, limit: int | None = None) -> DataFrame:
    """Scored relations without hidden verdicts and statuses, best first; the limit is the caller's top-k."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    e = scored(e, today).where(~F.col("verdict").isin(*hide) & ~F.col("status").isin(*exclude_status) & (F.col("score") >= min_score))
    return e.orderBy(F.col("score").desc(), "edge_id").limit(limit) if limit else e


def relation_rows(edges: DataFrame, today: str) -> DataFrame:
    """What a relation shows: self-loops, hidden and expired ones dropped, the score held at 1 and rounded."""
    e = relations(edges.where("src <> tgt"), today)
    cycle = F.col("refresh_cycle_days")
    return e.select("edge_id", "src", "tgt", "type", F.when(F.col("subtype") != "", F.col("subtype")).alias("subtype"), F.col("type").isin(*S.SYMMETRIC).alias("symmetric"), F.col("status").alias("freshness"), E.three(F.least("score", F.lit(1.0))).alias("score"), "verdict", "days_since", (cycle - F.col("days_since")).alias("days_until_refresh"), E.category().alias("category"))


def one_hop(edges: DataFrame) -> DataFrame:
    """(key, other, outgoing, ...) for both ends of every edge; a self-loop stands once, as outgoing."""
    out = edges.withColumnsRenamed({"src": "key", "tgt": "other"}).withColumn("outgoing", F.lit(True))
    back = edges.where("src <> tgt").withColumnsRenamed({"tgt": "key", "src": "other"}).withColumn("outgoing", F.lit(False))
    return out.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(key, degree): edges at either end, a self-loop once; counted per end before ends are put together."""
    out = edges.groupBy(F.col("src").alias("key")).count()
    back = edges.where("src <> tgt").groupBy(F.col("tgt").alias("key")).count()
    return out.unionByName(back).groupBy("key").agg(F.sum("count").alias("degree"))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n per key on the map side before it shuffles."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def direction(anchor: str) -> Column:
    """outgoing, incoming, or null where the anchor is at neither or both ends."""
    a, b = F.col("src") == anchor, F.col("tgt") == anchor
    return F.when(a & ~b, "outgoing").when(b & ~a, "incoming")


def within(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges with both ends among keys, which are the caller's few: a filter that reaches the scan."""
    return edges.where(F.col("src").isin(*keys) & F.col("tgt").isin(*keys))
