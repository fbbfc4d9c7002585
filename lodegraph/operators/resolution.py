"""Entity resolution: pairs by rule, closed to groups by distributed components, in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def blocked_pairs(items: DataFrame, block: Sequence[str], ident: str) -> DataFrame:
    """Links within blocks in linear number: each item with the least of its block. For rules that hold blockwise."""
    least = items.groupBy(*block).agg(F.min(ident).alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return items.join(least, list(block)).where(F.col(ident) != F.col("a")).select("a", F.col(ident).alias("b")).distinct()


def connected(edges: DataFrame, checkpoint, most_rounds: int = 200) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): least reachable node, by large-star and small-star rounds.

    Each node's neighbours are tied to its least neighbour until every component is a star, whatever the order of ids
    along a path. Rounds end only when nothing changes; if most_rounds is not enough that is an error. checkpoint cuts
    each round's lineage in the shared folder; minima are aggregated before the shuffle.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpoint(edges.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        e = checkpoint(small.where("a <> b").distinct())
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    stars = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def event_pairs(events: DataFrame, *, months: int = 2) -> DataFrame:
    """(a, b): events of one company and type whose months lie within `months` of each other, as chains.

    Sorted by month within company and type, neighbours within the gap are linked: a linear number of links whose
    components are those of all such pairs.
    """
    from pyspark.sql.window import Window as W

    e = events.select("event_id", "company", "event_type", V.month_number(F.col("occurred_at")).alias("m"))
    w = W.partitionBy("company", "event_type").orderBy("m", "event_id")
    return e.withColumn("p", F.lag("event_id").over(w)).withColumn("pm", F.lag("m").over(w)).where(F.col("m") - F.col("pm") <= months).select(F.col("p").alias("a"), F.col("event_id").alias("b"))


def event_runs(events: DataFrame, *, months: int = 2) -> DataFrame:
    """(a, b): events of one company and type whose months lie within `months` of each other, as stars; event_pairs has them as chains.

    Sorted by month within company and type, events with no wider gap between neighbours are a run, each linked to the
    run's first: a linear number of links whose components are those of all such pairs, complete after a round.
    """
    from pyspark.sql.window import Window as W

    e = events.select("event_id", "company", "event_type", V.month_number(F.col("occurred_at")).alias("m")).where("m IS NOT NULL")
    w = W.partitionBy("company", "event_type").orderBy("m", "event_id")
    near = F.coalesce(F.col("m") - F.lag("m").over(w) <= months, F.lit(False))
    first = F.last(F.when(~F.col("near"), F.col("event_id")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return e.withColumn("near", near).withColumn("a", first).where("near").select("a", F.col("event_id").alias("b"))
