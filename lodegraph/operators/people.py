"""Persons: keys within a document, births by name, and rows of one person that rules let merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resolution
from .skew import skew_join


def births_by_name(rows: DataFrame) -> DataFrame:
    """(name, birth) of names (name, birth) that have one birth only: an ambiguous name gives none."""
    known = rows.where("name is not null and birth is not null").groupBy("name").agg(F.min("birth").alias("birth"), F.max("birth").alias("_most"))
    return known.where("birth = _most").drop("_most")


def document_keys(persons: DataFrame) -> DataFrame:
    """(doc, key, canonical): within a document a name's rows take the first key (by pos) that has a birth, name|birth."""
    firm = persons.where(F.contains("key", F.lit("|"))).groupBy("doc", "name").agg(F.min_by("key", F.struct("pos", "key")).alias("canonical"))
    return persons.join(firm, ["doc", "name"], "left").select("doc", "key", F.coalesce("canonical", "key").alias("canonical"))


def roster_pairs(rosters: DataFrame, overlap: int, index=None) -> DataFrame:
    """(a, b, n): firms of rosters (company, member), a < b, with at least `overlap` members in common.

    Of a firm's n members in order of how few firms have them, the first n - overlap + 1 are enough: a pair shares one
    of these in both. So members whom many firms have, who would pair all of them, are hardly met. Pairs are told apart
    before the whole rosters, on which they are counted, come along. index writes the table of rosters, which is read
    more than once.
    """
    index = index or (lambda df: df)
    r = rosters.where("company IS NOT NULL AND member IS NOT NULL").select("company", "member").distinct()
    firms = r.groupBy("member").agg(F.count("*").alias("firms"))
    ordered = F.sort_array(F.collect_list(F.struct("firms", "member")))["member"]
    held = index(skew_join(r, firms, "member").groupBy("company").agg(ordered.alias("members")).where(F.size("members") >= overlap))
    first = held.select("company", F.explode(F.slice("members", F.lit(1), F.size("members") - overlap + 1)).alias("member"))
    a, b = (first.withColumnRenamed("company", c) for c in "ab")
    met = a.join(b.hint("merge"), "member").where("a < b").select("a", "b").distinct()  # spread by member: the table is one small file
    of = lambda c: held.select(F.col("company").alias(c), F.col("members").alias(f"of_{c}"))
    return met.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("n")).where(F.col("n") >= overlap)


def merge_persons(persons: DataFrame, holdings: DataFrame, rosters: DataFrame, checkpoint, *, overlap: int = 2) -> DataFrame:
    """(key, keep): persons (key, name, birth, self_owner) of one name that are one person.

    Two rows go together if they hold posts in one firm (holdings: key, company), both are owners themselves, or hold
    posts in two firms whose rosters (company, member) share `overlap` members; never with two different births. Links
    are formed within a name by equal keys, not between all its rows: a firm, a group of firms, or the owners. A
    component with two births is split by birth, its rows without one staying with the least.
    """
    both = roster_pairs(rosters, overlap, checkpoint)  # a table, as it is read four times
    groups = resolution.connected(both.select("a", "b"), checkpoint).withColumnRenamed("node", "company")
    posts = holdings.distinct().join(groups, "company", "left").select("key", F.coalesce("component", "company").alias("block"))
    rows = persons.join(posts, "key").select("key", "name", F.concat(F.lit("firm "), "block").alias("block"))
    owners = persons.where("self_owner").select("key", "name", F.lit("owner").alias("block"))
    links = resolution.blocked_pairs(rows.unionByName(owners), ["name", "block"], "key")
    parts = resolution.connected(links, checkpoint).withColumnsRenamed({"node": "key"})
    named = persons.join(parts, "key").select("key", "birth", "component")
    least = named.groupBy("component").agg(F.min("birth").alias("first"))
    named = named.join(least, "component").withColumn("born", F.coalesce("birth", "first"))
    keep = named.groupBy("component", F.coalesce("born", F.lit("")).alias("b")).agg(F.min_by("key", F.struct(F.col("birth").isNull().alias("n"), F.col("key"))).alias("keep"), F.count("*").alias("n")).where("n > 1")
    j = named.withColumn("b", F.coalesce("born", F.lit(""))).join(keep.drop("n"), ["component", "b"])
    return j.where("key <> keep").select("key", "keep")
