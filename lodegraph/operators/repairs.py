"""Repairs: each makes a new version of nodes or edges by joins on keys. Judgements enter as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S

#: Endings that mark a unit of a firm.
UNIT_ENDINGS = ("사업부", "사업본부", "사업부문", "부문", "본부", "공장", "제조시설", "생산기술원", "기술원", "연구소", "연구원", "사업소", "캠퍼스", "랩", "센터")


def free_of_slashes(nodes: DataFrame, key: str = "key") -> DataFrame:
    """(old, keep): keys with slashes and their form without, unless another node has that or two would get it."""
    new = nodes.where(F.contains(key, F.lit("/"))).select(F.col(key).alias("old"), F.replace(key, F.lit("/"), F.lit("")).alias("keep"))
    single = new.groupBy("keep").agg(F.min("old").alias("old"), F.count("*").alias("n")).where("n = 1 and keep <> ''").select("old", "keep")
    return single.join(nodes.select(F.col(key).alias("keep")), "keep", "left_anti").select("old", "keep")


def units_of_parents(names: DataFrame, parents: DataFrame, endings: tuple[str, ...] = UNIT_ENDINGS) -> DataFrame:
    """(key, parent, unit): names that are a parent's name and the name of a unit; the longest parent wins.

    Prefixes of a name are exploded (one row per character) and equi-joined; no name meets every parent.
    """
    ends = F.col("unit").rlike("(" + "|".join(endings) + ")$")
    n = names.select("key", F.col("name").alias("whole")).where(F.length("whole") >= 3)
    p = n.select("key", "whole", F.explode(F.sequence(F.lit(2), F.length("whole") - 1)).alias("n"))
    p = p.withColumn("prefix", F.expr("substring(whole, 1, n)")).withColumn("unit", F.trim(F.expr("substring(whole, n + 1)"))).where(ends)
    hit = p.join(parents.select(F.col("key").alias("parent"), F.col("name").alias("prefix")), "prefix").where("key <> parent")
    best = F.max_by(F.struct("parent", "unit"), F.struct("n", F.col("parent")))
    return hit.groupBy("key").agg(best.alias("b")).select("key", "b.parent", "b.unit")


def retype_action(types: DataFrame, rules: DataFrame) -> DataFrame:
    """edges (edge_id, type, src_label, tgt_label, hint) with action and new_type.

    invert: the hint is the edge's own type with a change of direction, and the matrix allows it; hold: the hint is the
    type itself; reject: the matrix forbids what is hinted; flip: it allows it the other way round; retype: it allows it.
    """
    ok = F.broadcast(rules.select(F.col("edge").alias("_e"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_ok")))  # the fixed matrix
    want = F.regexp_extract("hint", "^([A-Z_]+)", 1)
    e = types.withColumn("want", want)
    forth = ok.withColumnRenamed("_ok", "forth")
    back = ok.withColumnRenamed("_ok", "back")
    j = e.join(forth, (F.col("want") == F.col("_e")) & (F.col("src_label") == F.col("_a")) & (F.col("tgt_label") == F.col("_b")), "left").drop("_e", "_a", "_b")
    j = j.join(back, (F.col("want") == F.col("_e")) & (F.col("tgt_label") == F.col("_a")) & (F.col("src_label") == F.col("_b")), "left").drop("_e", "_a", "_b")
    turned = F.contains("hint", F.lit("방향"))
    action = (
        F.when((F.col("want") == F.col("type")) & turned, F.when(F.col("back"), "invert").otherwise("reject"))
        .when(F.col("want") == F.col("type"), "hold").when(F.col("forth"), "retype").when(F.col("back"), "flip").otherwise("reject")
    )
    out = j.withColumn("action", action).withColumn("new_type", F.when(F.col("action").isin("retype", "flip", "invert"), F.col("want")).otherwise(F.col("type")))
    return out.drop("want", "forth", "back")


def split_events(verdicts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New keys and moved edges of events that are several: verdicts (event_id, label, doc), edges (event_id, doc, ...).

    A document belongs to the first label that has it; an event left with one label stays. The label with most
    documents keeps the id, the others get one made of the event, the label and their documents.
    """
    from ..functions import values as V

    first = verdicts.groupBy("event_id", "doc").agg(F.min("label").alias("label"))
    groups = first.groupBy("event_id", "label").agg(F.array_sort(F.collect_set("doc")).alias("docs")).withColumn("n", F.size("docs"))
    w = W.partitionBy("event_id")
    ranked = groups.withColumn("of", F.count("*").over(w)).where("of > 1").withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), "label")))
    keys = ranked.withColumn("new_id", F.when(F.col("r") == 1, F.col("event_id")).otherwise(V.stable_id("evt_split_", 12, F.col("event_id"), F.col("label"), F.array_join("docs", "|"))))
    keys = keys.select("event_id", "label", "new_id", "docs")
    to = keys.where("new_id <> event_id").select("event_id", F.explode("docs").alias("doc"), "new_id")
    moved = edges.join(to, ["event_id", "doc"], "left").withColumn("event_id", F.coalesce("new_id", "event_id")).drop("new_id")
    return keys, moved


def convergent_subtypes(counts: DataFrame, protected: Column) -> DataFrame:
    """(type, subtype, keep) from counts (type, subtype, n): spellings that differ in notation converge to the most used.

    A form for which `protected` holds stays itself, and is preferred as the one that others converge to.
    """
    from ..functions import text as T

    c = counts.withColumn("safe", protected).withColumn("flat", T.compact(F.col("subtype"))).where("flat <> ''")
    best = c.groupBy("type", "flat").agg(F.max_by("subtype", F.struct("safe", "n", F.length("subtype"), F.col("subtype"))).alias("keep"), F.count("*").alias("k")).where("k > 1")
    return c.join(best.select("type", "flat", "keep"), ["type", "flat"]).where("subtype <> keep and not safe").select("type", "subtype", "keep")


def ambiguous_firms(candidates: DataFrame) -> DataFrame:
    """(key, codes) of keys with two or more codes of which not exactly one is listed, from candidates (key, code, listed)."""
    g = candidates.groupBy("key").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.count_distinct(F.when(F.col("listed"), F.col("code"))).alias("listed"))
    return g.where((F.size("codes") > 1) & (F.col("listed") != 1)).select("key", "codes")


def legal(edge: Column, source: Column, target: Column) -> Column:
    """Whether the matrix allows an edge; symmetric types either way."""
    allowed = {e: {(a, b) for x, _, a, b in S.EDGE_RULES if x == e} for e, *_ in S.EDGE_MATRIX}
    pairs = [f"{e}>{a}>{b}" for e, ab in allowed.items() for a, b in ab | ({(b, a) for a, b in ab} if e in S.SYMMETRIC else set())]
    return F.concat_ws(">", edge, source, target).isin(*sorted(pairs))
