"""Two-hop patterns: shared customers, bridges, bottlenecks, risk propagation.

A pattern never binds one edge twice. Pairs that meet at a hub are not formed: each side is reduced to distinct
(anchor, middle) pairs first, the anchors are the caller's few companies, and only they are joined with the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import edges as E
from ..sources.graph import over
from .relations import degrees, one_hop, scored, top_per_key


def shared_targets(edges: DataFrame, anchors: Sequence[str], peers: Sequence[str] | None = None, *, unlinked: bool = True) -> DataFrame:
    """(anchor, peer, n, shared): peers that share targets with the anchors; unlinked drops pairs with an edge of their own."""
    pairs = edges.select("src", "tgt").distinct()
    mine = pairs.where(F.col("src").isin(*anchors)).withColumnRenamed("src", "anchor")
    theirs = pairs.where(F.col("src").isin(*peers)) if peers else pairs
    met = mine.join(theirs.withColumnRenamed("src", "peer"), "tgt").where("anchor <> peer")
    pair = ["anchor", "peer"]
    five = top_per_key(met, pair, [F.col("tgt")], 5).groupBy(*pair).agg(F.array_sort(F.collect_list("tgt")).alias("shared"))
    out = met.groupBy(*pair).agg(F.count("*").alias("n")).join(five, pair)
    if unlinked:
        ends = one_hop(edges).where(F.col("key").isin(*anchors)).select(F.col("key").alias("anchor"), F.col("other").alias("peer")).distinct()
        out = out.join(ends, ["anchor", "peer"], "left_anti")
    return out


def bridges(edges: DataFrame, islands: Sequence[str], others: Sequence[str], *, most_degree: int = 150, n: int = 3) -> DataFrame:
    """(island, mid, reach, degree): middle nodes outside both that lead from an island to most others."""
    use = edges.where(~F.coalesce("suspect", F.lit(False)) & F.coalesce("is_current", F.lit(True)))
    hop = one_hop(use).select("key", "other").distinct()
    inside = [*islands, *others]
    first = hop.where(F.col("key").isin(*islands) & ~F.col("other").isin(*inside)).select(F.col("key").alias("island"), F.col("other").alias("mid"))
    second = hop.where(F.col("key").isin(*others)).select(F.col("other").alias("mid"), F.col("key").alias("reached"))
    reach = first.join(second, "mid").where("island <> reached").groupBy("island", "mid").agg(F.count_distinct("reached").alias("reach"))
    full = reach.join(degrees(edges).withColumnRenamed("key", "mid"), "mid").where(F.col("degree") <= most_degree)
    from .relations import top_per_key

    return top_per_key(full, ["island"], [F.col("reach").desc(), F.col("degree"), F.col("mid")], n)


def bottlenecks(first: DataFrame, second: DataFrame, anchors: Sequence[str], *, at_least: int = 2, most_degree: int = 60) -> DataFrame:
    """(mid, hits, n_dst, degree): middles outside the workspace through which several of it reach the outside.

    first and second are the edges of the two hops (src, tgt); the degree counts both.
    """
    a = first.where(F.col("src").isin(*anchors) & ~F.col("tgt").isin(*anchors)).select("src", F.col("tgt").alias("mid")).distinct()
    b = second.where(~F.col("src").isin(*anchors) & ~F.col("tgt").isin(*anchors)).select(F.col("src").alias("mid"), "tgt").distinct()
    hits = a.groupBy("mid").agg(F.count("*").alias("hits")).where(F.col("hits") >= at_least)
    reached = b.groupBy("mid").agg(F.count("*").alias("n_dst"))
    both = first.select("src", "tgt").unionByName(second.select("src", "tgt"))
    return hits.join(reached, "mid").join(degrees(both).withColumnRenamed("key", "mid"), "mid").where(F.col("degree") <= most_degree)


def with_fan(best: DataFrame, legs: DataFrame) -> DataFrame:
    """best (company, channel, ...) with `fan`, the legs of its company and channel; joined by company alone, by which best may lie already."""
    fan = legs.groupBy("company").agg(F.count_if(F.col("channel") == "supply").alias("_supply"), F.count_if(F.col("channel") == "demand").alias("_demand"))
    return best.join(fan, "company").withColumn("fan", F.when(F.col("channel") == "supply", F.col("_supply")).otherwise(F.col("_demand"))).drop("_supply", "_demand")


def propagate(impacts: DataFrame, edges: DataFrame, today: str, *, min_score: float = S.MIN_SCORE, tasks: int | None = None) -> DataFrame:
    """(event_id, company, hops, score, channel): what an event does to companies, reported and through supply.

    First hop: confidence of the impact (it has no date of its own, so it counts as unknown). Second: over visible
    edges that have not ended, down to customers and up to suppliers with their own decay, weakened by the fan of the
    company passed. Each company keeps its best; of equals the reported one. tasks is over how many of them legs, by
    company, and what they reach, by event, are dealt.
    """
    direct = impacts.select("event_id", F.col("target").alias("company"), (E.or_default("confidence", S.DEFAULT_CONFIDENCE) * S.UNKNOWN).alias("s1"))
    seen = scored(edges.where(E.visible_to_propagation()), today)
    flow = lambda a, b, name, decay: seen.select(F.col(a).alias("company"), F.col(b).alias("other"), F.col("factor"), F.coalesce("is_current", F.lit(True)).alias("on"), F.lit(name).alias("channel"), F.lit(decay).alias("decay"))
    legs = flow("src", "tgt", "supply", S.HOP_SUPPLY).unionByName(flow("tgt", "src", "demand", S.HOP_DEMAND))
    # Of parallel edges between two companies only the freshest can win, so legs are reduced before events meet them.
    best = over(legs.where("on"), tasks, "company").groupBy("company", "other", "channel", "decay").agg(F.max("factor").alias("factor"))
    best = with_fan(best, legs).withColumn("weight", F.col("decay") * F.col("factor") * E.hub_penalty(F.col("fan")))
    # A leg too weak for the surest event is too weak for all; half a unit of the rounded score is left as margin.
    best = best.where(F.col("weight") * direct.agg(F.max("s1")).scalar() >= min_score - 1e-6)
    second = over(direct, tasks, "company").join(best, "company").select("event_id", F.col("other").alias("company"), F.lit(2).alias("hops"), (F.col("s1") * F.col("weight")).alias("score"), "channel")
    first = direct.select("event_id", "company", F.lit(1).alias("hops"), F.col("s1").alias("score"), F.lit("").alias("channel"))
    all_ = first.unionByName(second.where("company is not null")).withColumn("score", E.three(F.col("score"), 6)).where(F.col("score") >= min_score)
    all_ = over(all_, tasks, "event_id")
    pick = F.max(F.struct("score", (-F.col("hops")).alias("h"), "channel")).alias("p")
    return all_.groupBy("event_id", "company").agg(pick).select("event_id", "company", (-F.col("p.h")).alias("hops"), F.col("p.score").alias("score"), F.col("p.channel").alias("channel"))
