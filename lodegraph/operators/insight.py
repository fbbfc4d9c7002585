"""Insights of a workspace: concentration by lift, sectors, stale loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S
from ..functions import edges as E


def base_rates(edges: DataFrame) -> DataFrame:
    """(tgt, k): how many distinct sources each target has in all, without suspect edges."""
    return edges.where(~F.coalesce("suspect", F.lit(False))).groupBy("tgt").agg(F.count_distinct("src").alias("k"))


def concentration(edges: DataFrame, companies: DataFrame, members: Sequence[str], today: str, *, min_shared: int = S.MIN_SHARED, min_lift: float = S.MIN_LIFT) -> DataFrame:
    """(subject, hits, base, lift, label): targets that members share more than chance would have it.

    Live edges count for the members, all that are not suspect for the base. The two totals are one-row aggregates.
    """
    mine = edges.where(E.live(today) & F.col("src").isin(*members)).select("src", "tgt").distinct()
    hits = mine.groupBy("tgt").agg(F.count("*").alias("hits")).where(F.col("hits") >= min_shared)
    one = companies.agg(F.count("*").alias("total")).join(mine.agg(F.count_distinct("src").alias("of")))
    j = hits.join(base_rates(edges).withColumnRenamed("k", "base"), "tgt").join(one)
    lift = (F.col("hits").cast("double") / F.col("of")) / (F.col("base").cast("double") / F.col("total"))
    j = j.withColumn("raw", lift).where(F.col("raw") >= min_lift)
    label = F.when(F.col("raw") >= 100, "extraordinary").when(F.col("raw") >= 30, "unusual").otherwise("concentrated")
    return j.select(F.col("tgt").alias("subject"), "hits", "base", E.three(F.col("raw"), 1).alias("lift"), label.alias("label"))


def sector_mode(pairs: DataFrame, *, least: int = 2, least_percent: int = 60) -> DataFrame:
    """(tgt, sector, n, total): the leading sector of each target's sources, where it leads clearly."""
    c = pairs.groupBy("tgt", "sector").agg(F.count("*").alias("n"))
    top = c.groupBy("tgt").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), F.col("sector"))).alias("b"))
    return top.select("tgt", F.col("b.sector").alias("sector"), (-F.col("b.m")).alias("n"), "total").where((F.col("n") >= least) & (F.col("n") * 100 >= least_percent * F.col("total")))


def missing_from_newest_load(edges: DataFrame, *, days: int) -> DataFrame:
    """Edges last seen more than `days` before the newest edge of their source."""
    newest = edges.groupBy("src").agg(F.max("last_seen").alias("newest"))
    return edges.join(newest, "src").where(F.datediff(F.col("newest").cast("date"), F.col("last_seen").cast("date")) > days)


def round_robin(df: DataFrame, kind: str, order: Sequence, kinds: Sequence[str], budget: int) -> DataFrame:
    """Takes one row of each kind in turn, kinds in the given order, until the budget is spent; adds turn."""
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    r = df.withColumn("turn", F.row_number().over(W.partitionBy(kind).orderBy(*order)))
    return r.where(F.col("turn") <= budget).orderBy("turn", place, kind).limit(budget)
