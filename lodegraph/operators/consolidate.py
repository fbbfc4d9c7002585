"""Consolidation: parallel edges become one with all its evidence, subtypes get a representative, keys are remapped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.graph import day, key


def line_edges(lines: DataFrame) -> DataFrame:
    """One edge per order line, as a multi-set to consolidate."""
    return lines.select(
        key("S", "l_suppkey").alias("src"), key("C", "o_custkey").alias("tgt"), F.col("l_returnflag").alias("subtype"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
        ((10 - F.round(F.col("l_discount") * 100).cast("int")) / 10).alias("confidence"), day(F.col("l_shipdate")).alias("last_seen"), F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("source_doc"),
    )


def dedup_edges(edges: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Per key: n, survivor (most confident, then latest seen, then least ident), source_docs, last_seen.

    Sets and maxima are aggregated on the map side, so a hot pair ships one partial row per task.
    """
    best = F.max_by(F.struct(ident, "confidence", "last_seen"), F.struct(F.coalesce("confidence", F.lit(0.0)).alias("a"), F.coalesce("last_seen", F.lit("")).alias("b"), (-F.col(ident)).alias("c")))
    return edges.groupBy(*keys).agg(F.count("*").alias("n"), best.alias("survivor"), F.array_sort(F.collect_set("source_doc")).alias("source_docs"), F.max("last_seen").alias("last_seen"))


def cluster_subtypes(edges: DataFrame, keys: Sequence[str], *, type_name: str) -> DataFrame:
    """Per key: the representative subtype, n, n_subtypes.

    Candidates narrow in steps, each undone if it leaves none: not the type's own name, no numbers with units, Hangul.
    Of what is left the most frequent, then the longest, then the least.
    """
    counts = edges.groupBy(*keys, "subtype").agg(F.count("*").alias("c"))
    named = F.coalesce(F.col("subtype") != type_name, F.lit(False)) & (F.col("subtype") != "")
    plain = ~F.col("subtype").rlike(r"[0-9]+([.][0-9]+)? *(%|퍼센트|억|조|만원|억원)")
    rank = F.struct(plain.alias("p"), F.col("subtype").rlike("[가-힣]").alias("h"), F.col("c"), F.length("subtype").alias("l"))
    w = W.partitionBy(*keys).orderBy(rank.desc(), "subtype")
    best = counts.where(named).withColumn("r", F.row_number().over(w)).where("r = 1").select(*keys, F.col("subtype").alias("best"))
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("n_subtypes"))
    return sizes.join(best, list(keys), "left").select(*keys, F.coalesce("best", F.lit("")).alias("subtype"), "n", "n_subtypes")


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends led through mapping (old, keep); self-loops that this makes go."""
    m = mapping.select("old", "keep")
    e = edges
    for end in ("src", "tgt"):
        e = e.join(m.withColumnsRenamed({"old": end, "keep": f"_{end}"}), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return e.where("src <> tgt")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], *, take_new: Sequence[str] = (), first: Sequence[str] = (), add: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    """old and new by key: take_new overwrite, first keep the old value, add are summed, most keep the greater."""
    on = list(keys)
    n = new.withColumnsRenamed({c: f"_{c}" for c in new.columns if c not in on})
    j = old.join(n, on, "full_outer")
    pick = {c: F.coalesce(f"_{c}", c) for c in take_new}
    pick |= {c: F.coalesce(c, f"_{c}") for c in first}
    pick |= {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0)) for c in add}
    pick |= {c: F.greatest(c, f"_{c}") for c in most}
    return j.select(*on, *[v.alias(c) for c, v in pick.items()])


def latest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def merge_keeper(nodes: DataFrame, group: str, *, code: str, degree: str) -> DataFrame:
    """(old, keep) of nodes that share `group`: the one with a code, then of highest degree, then least key, stays.

    Groups with two different codes are different firms and are left alone.
    """
    best = F.struct(F.col(code).isNull().alias("a"), (-F.col(degree)).alias("b"), F.col("key").alias("c"))
    g = nodes.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(code).alias("codes"), F.min_by("key", best).alias("keep")).where("n > 1 and codes <= 1")
    return nodes.join(g.select(group, "keep"), group).where("key <> keep").select(F.col("key").alias("old"), "keep")
