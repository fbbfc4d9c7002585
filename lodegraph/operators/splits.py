"""Splits of events that can be undone: a log of moved edges, states as of a change, and phases dealt to the parts.

The log (change, edge_id, before, after) names for each move where an edge was and where it went. It is never rewritten:
undoing adds a row of the change to the undone ones. An edge is where the last move that counts has put it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

#: Fixed value: a phase further than so many months from every part goes.
FAR_MONTHS = 12


def moves(edges: DataFrame, keys: DataFrame, change: int) -> DataFrame:
    """The log of one change: edges (edge_id, event_id, doc) whose document belongs to a part of keys (event_id, new_id, docs)."""
    to = keys.where("new_id <> event_id").select("event_id", F.explode("docs").alias("doc"), "new_id")
    return edges.join(to, ["event_id", "doc"]).select(F.lit(change).cast("long").alias("change"), "edge_id", F.col("event_id").alias("before"), F.col("new_id").alias("after"))


def state(edges: DataFrame, log: DataFrame, *, as_of: int | None = None, undone: DataFrame | None = None) -> DataFrame:
    """edges (edge_id, event_id, ...) where the moves of log have put them: those up to as_of, without those undone (change).

    One aggregation by edge, of the moves alone; edges that no move names stay as they are.
    """
    counted = log if as_of is None else log.where(F.col("change") <= as_of)
    if undone is not None:
        counted = counted.join(undone.select("change").distinct(), "change", "left_anti")
    last = counted.groupBy("edge_id").agg(F.max_by("after", "change").alias("_at"))
    return edges.join(last, "edge_id", "left").withColumn("event_id", F.coalesce("_at", "event_id")).select(*edges.columns)


def inverse(log: DataFrame, last: int) -> DataFrame:
    """Moves that undo those of a log when they are made behind its last change: the last first, each edge back to where it was."""
    return log.select((2 * last + 1 - F.col("change")).alias("change"), "edge_id", F.col("after").alias("before"), F.col("before").alias("after"))


def spans(edges: DataFrame) -> DataFrame:
    """(event_id, low, high): the first and last month of an event's edges (event_id, occurred_at)."""
    m = edges.select("event_id", V.month_number(F.substring("occurred_at", 1, 7)).alias("m")).where("m IS NOT NULL")
    return m.groupBy("event_id").agg(F.min("m").alias("low"), F.max("m").alias("high"))


def dealt_phases(events: DataFrame, parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(event_id, timeline): of every event of a split its phases, those of the timeline before the split dealt to the nearest part.

    events (event_id, timeline) are as they are now; parts (orig_id, new_id, orig_timeline) come from the splits that
    stand. A phase (period|name|id) goes to the part in whose months it lies, else to the nearest up to FAR_MONTHS
    away; of equals the event itself comes first, then the least id. Phases without a month, or too far from all, go; so do
    all of an event whose parts have no month. What was added to a timeline after the split stays in front. Running it
    again changes nothing.
    """
    old = parts.where("orig_timeline IS NOT NULL").select("orig_id", F.posexplode("orig_timeline").alias("pos", "entry"))
    old = old.groupBy("orig_id", "entry").agg(F.min("pos").alias("pos"))
    family = parts.where("orig_timeline IS NOT NULL").select("orig_id", F.col("new_id").alias("event_id")).distinct()
    family = family.unionByName(family.select("orig_id", F.col("orig_id").alias("event_id")).distinct()).join(events.select("event_id"), "event_id", "left_semi")
    near = family.join(spans(edges), "event_id")
    m = old.withColumn("m", V.month_number(F.substring(F.split("entry", r"\|")[0], 1, 7))).where("m IS NOT NULL")
    far = F.greatest(F.col("low") - F.col("m"), F.col("m") - F.col("high"), F.lit(0))
    rank = F.struct(far.alias("far"), (F.col("event_id") != F.col("orig_id")).alias("other"), "event_id")
    best = m.join(near, "orig_id").groupBy("orig_id", "entry", "pos").agg(F.min(rank).alias("b")).where(F.col("b.far") <= FAR_MONTHS)
    given = best.select(F.col("b.event_id").alias("event_id"), F.struct("pos", "entry").alias("e")).groupBy("event_id").agg(F.sort_array(F.collect_list("e"))["entry"].alias("given"))
    gone = old.join(family, "orig_id").groupBy("event_id").agg(F.collect_set("entry").alias("old"))
    none = F.array().cast("array<string>")
    rows = family.select("event_id").distinct().join(events, "event_id").join(gone, "event_id", "left").join(given, "event_id", "left")
    own = F.filter(F.coalesce("timeline", none), lambda e: ~F.array_contains(F.coalesce("old", none), e))
    return rows.select("event_id", F.concat(own, F.coalesce("given", none)).alias("timeline"))
