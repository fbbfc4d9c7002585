"""What an event does to companies over several hops, with the path taken, and a fair share of lines per event.

An impact on a unit counts for the firm it belongs to, without decay: it is the same firm. From there a frontier of the
best score per event and company moves along supply, round by round; a leg's weight is under one, so what falls below
the least score never comes back, and the best way to a company in a number of hops goes over best ways only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S
from ..functions import edges as E
from ..sources.graph import over
from .patterns import with_fan
from .relations import scored


def lifted(impacts: DataFrame, units: DataFrame) -> DataFrame:
    """impacts (event_id, target, ...) on the firm instead of its unit, with `unit`, null where there is none; units (key, parent, unit) have one row per key."""
    u = units.where("parent IS NOT NULL").select(F.col("key").alias("target"), "parent", "unit")
    return impacts.join(u, "target", "left").withColumn("target", F.coalesce("parent", "target")).drop("parent")


def legs(edges: DataFrame, today: str, tasks: int | None = None) -> DataFrame:
    """(company, other, channel, weight): down to customers and up to suppliers; of parallel edges the freshest. Edges that have ended count for the fan alone."""
    seen = scored(edges.where(E.visible_to_propagation()), today)
    flow = lambda a, b, name, decay: seen.select(F.col(a).alias("company"), F.col(b).alias("other"), "factor", F.coalesce("is_current", F.lit(True)).alias("on"), F.lit(name).alias("channel"), F.lit(decay).alias("decay"))
    both = flow("src", "tgt", "supply", S.HOP_SUPPLY).unionByName(flow("tgt", "src", "demand", S.HOP_DEMAND))
    on = over(both.where(F.col("on") & F.col("other").isNotNull()), tasks, "company")
    best = on.groupBy("company", "other", "channel", "decay").agg(F.max("factor").alias("factor"))
    return with_fan(best, both).select("company", "other", "channel", (F.col("decay") * (F.col("factor") * E.hub_penalty(F.col("fan")))).alias("weight"))


def spread(impacts: DataFrame, edges: DataFrame, today: str, write, *, max_hops: int = 2, min_score: float = S.MIN_SCORE, tasks: int | None = None) -> DataFrame:
    """(event_id, company, hops, score, stated, channel, path): every company an event reaches, by its best way.

    impacts (event_id, target, confidence, unit). Of equal scores the fewest hops stand, then the greatest channel, then
    the least path. path lists (company, channel) from the first hop on; the first has the unit that was hit. write makes
    a table of each round's frontier, which holds one row per event and company. tasks is over how many of them legs and
    the frontier, by company, and what it reaches, by event, are dealt.
    """
    base = E.or_default("confidence", S.DEFAULT_CONFIDENCE) * S.UNKNOWN
    first = impacts.where("target IS NOT NULL").select("event_id", F.col("target").alias("company"), F.lit(1).alias("hops"), base.alias("raw"), F.lit("").alias("channel"), F.array(F.struct(F.col("target").alias("company"), F.coalesce("unit", F.lit("")).alias("channel"))).alias("path"))
    frontier = write(_best(over(first.where(F.col("raw") >= min_score - 1e-6), tasks, "event_id")))
    steps, found = write(legs(edges, today, tasks)), frontier
    for hop in range(2, max_hops + 1):
        # a leg too weak for the surest company of the frontier is too weak for all
        strong = steps.where(F.col("weight") * frontier.agg(F.max("raw")).scalar() >= min_score - 1e-6)
        met = over(frontier.select("event_id", "company", "raw", "path"), tasks, "company").join(over(strong, tasks, "company"), "company").withColumn("raw", F.col("raw") * F.col("weight")).where(F.col("raw") >= min_score - 1e-6)
        grown = F.concat("path", F.array(F.struct(F.col("other").alias("company"), "channel")))
        reached = met.select("event_id", F.col("other").alias("company"), F.lit(hop).alias("hops"), "raw", "channel", grown.alias("path"))
        frontier = write(_best(over(reached, tasks, "event_id")))
        found = found.unionByName(frontier)
    rounded = _best(over(found.withColumn("score", E.three(F.col("raw"), 6)).where(F.col("score") >= min_score), tasks, "event_id"), "score")
    return rounded.select("event_id", "company", "hops", "score", (F.col("hops") == 1).alias("stated"), "channel", "path")


def _best(rows: DataFrame, by: str = "raw") -> DataFrame:
    """The best row per event and company; aggregated before the shuffle."""
    least = F.min(F.struct((-F.col(by)).alias("s"), "hops", F.when(F.col("channel") == "supply", 0).when(F.col("channel") == "demand", 1).otherwise(2).alias("c"), "path", "channel")).alias("b")
    out = rows.groupBy("event_id", "company").agg(least)
    return out.select("event_id", "company", "b.hops", (-F.col("b.s")).alias(by), "b.channel", "b.path")


def event_impact(found: DataFrame, events: Sequence[str], max_hops: int) -> DataFrame:
    """What spread() found for the given events, up to so many hops, best first within each."""
    return found.where(F.col("event_id").isin(*events) & (F.col("hops") <= max_hops)).withColumn("pos", F.row_number().over(W.partitionBy("event_id").orderBy(F.col("score").desc(), "company")))


def fair_lines(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The lines that an answer shows, dealt to its events in turns, and (answer_id, event_id, dropped) of those it does not.

    rows (answer_id, event_id, pos, stated, ...): events come in the order of their first line; within one, what an
    article states comes first, then the order of lines. Only the first `limit` lines of an event can be shown, so no
    more of them are ordered against those of other events.
    """
    of = W.partitionBy("answer_id", "event_id")
    n = rows.withColumn("_first", F.min("pos").over(of)).withColumn("_nth", F.row_number().over(of.orderBy(~F.col("stated"), "pos")))
    turn = F.row_number().over(W.partitionBy("answer_id").orderBy("_nth", "_first"))
    kept = n.where(F.col("_nth") <= limit).withColumn("turn", turn).where(F.col("turn") <= limit)
    shown = kept.groupBy("answer_id", "event_id").agg(F.count("*").alias("shown"))
    every = rows.groupBy("answer_id", "event_id").agg(F.count("*").alias("n"))
    dropped = every.join(shown, ["answer_id", "event_id"], "left").select("answer_id", "event_id", (F.col("n") - F.coalesce("shown", F.lit(0))).alias("dropped")).where("dropped > 0")
    return kept.drop("_first", "_nth", "turn"), dropped
