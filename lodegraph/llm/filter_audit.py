"""Operator 13: what each of several filters removes, keeps and costs, in every order of applying them.

One pass over the texts gives a narrow row each: part, the filters it fails as bits, its length in code points and one
hash per block of its text. Each block ends at eight times the end of the one before, so very long texts have a handful.

Exact copies are found by refining a partition: first by length, then by the hash of the first block, of the second, and
so on; after each step the classes of a single row go. A row leaves the rounds when its text has no further block. Of
what survives, the full texts are compared: within a class, texts are grouped as they are, copies falling together
before the shuffle, and the least id of each text is kept. A row fails as a copy if its id is greater than that.

Then rows are counted by part and bits alone; five filters make at most 32 sets of bits, and the 120 orders are worked
out on these counts.

Classes that hold over a thousandth of all rows are joined by broadcast (there are under a thousand), all others by
shuffling, so a text that is a third of the table meets in no task.

Edge cases: a null text is an empty one, and fails as too short; null and empty parts are one part, ''; a row of null
id is never a copy and makes none, has no label, and counts like any other; rows that repeat an id and text are no
copies of each other; of several labels of one id, any 1 counts; long texts are read whole; an empty table has no parts,
hence no rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points of the first block, and how far each block's end lies beyond the one before.
FIRST_BLOCK, GROWTH = 256, 8
#: A class is hot with more than one in so many of all rows.
HOT_SHARE = 1000
#: Classes of copies up to which their list is broadcast to the scan that compares texts; beyond, the join shuffles.
MOST_BROADCAST = 1_000_000
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_faults(text: Column) -> Column:
    """The bits of the filters that look at one text."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")
    faults = {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return reduce(Column.__add__, [F.when(fails, 1 << LETTERS.index(k)).otherwise(0) for k, fails in faults.items()])


def block_ends(longest: int) -> list[int]:
    ends = [FIRST_BLOCK]
    while ends[-1] < longest:
        ends.append(ends[-1] * GROWTH)
    return ends


def block_hashes(text: Column, ends: list[int]) -> Column:
    """One hash per block that the text reaches."""
    blocks = zip([0, *ends[:-1]], ends, strict=True)
    return F.array_compact(F.array(*[F.when(F.length(text) > a, F.xxhash64(F.substring(text, a + 1, z - a))) for a, z in blocks]))


def class_of(blocks: int) -> Column:
    """The class of a row by its length and so many blocks; with all of its blocks, or more, it is the final one."""
    return F.xxhash64("length", F.slice("hashes", 1, blocks)) if blocks else F.xxhash64("length")


def joined(rows: DataFrame, classes: DataFrame, total: int, how: str) -> DataFrame:
    """rows joined with classes (cls, n, ...) on cls: the hot classes by broadcast, the others by shuffling."""
    least = max(total // HOT_SHARE, 1)
    hot, cold = F.broadcast(classes.where(F.col("n") > least)), classes.where(F.col("n") <= least)
    rest = rows.join(hot.select("cls"), "cls", "left_anti")
    first = rows.join(hot, "cls", "inner" if how == "left" else how)
    return first.unionByName(rest.join(cold, "cls", how).select(first.columns))


def copy_classes(rows: DataFrame, ends: list[int], total: int) -> DataFrame:
    """(cls, n): the classes by length and all blocks that have two rows or more. Each round is a written table."""
    held, final = rows.select("length", "hashes"), []
    for blocks in range(len(ends) + 1):
        keyed = held.select(class_of(blocks).alias("cls"), "length", "hashes")
        classes = common.written(keyed.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1"), "copies-classes")
        survived = common.written(joined(keyed, classes, total, "left_semi"), "copies-rows")
        if blocks:
            whole = F.col("length") <= ends[blocks - 1]
            final.append(survived.where(whole).groupBy("cls").agg(F.count("*").alias("n")))
            survived = survived.where(~whole)
        held = survived
    return common.written(reduce(DataFrame.unionByName, final), "copies-final")


def least_ids(docs: DataFrame, classes: DataFrame, ends: list[int]) -> DataFrame:
    """(cls, text, least, n): of each text in classes its least id and its rows; the full texts are compared."""
    rows = docs.withColumn("length", F.length("text")).withColumn("hashes", block_hashes(F.col("text"), ends))
    rows = rows.select("doc_id", "text", class_of(len(ends)).alias("cls"))
    found = F.broadcast(classes.select("cls")) if classes.count() <= MOST_BROADCAST else classes.select("cls")
    return common.written(rows.join(found, "cls", "left_semi").groupBy("cls", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "copies-texts")


def with_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bits) per row of docs (doc_id, part, text), whose bits include COPY where a lesser id has the same text."""
    longest = docs.agg(F.max(F.length("text"))).first()[0] or 0
    ends = block_ends(longest)
    rows = docs.select("doc_id", "part", text_faults(F.col("text")).alias("bits"), F.length("text").alias("length"), block_hashes(F.col("text"), ends).alias("hashes"))
    rows = common.written(rows, "audit-rows")
    total = rows.count()
    texts = least_ids(docs, copy_classes(rows, ends, total), ends)
    classes = common.written(texts.groupBy("cls").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.count("*").alias("texts")), "copies-least")
    plain = classes.where("texts = 1").drop("texts")
    copy = F.when(F.col("doc_id") > F.col("least"), COPY).otherwise(0)
    marked = joined(rows.select("doc_id", "part", "bits", class_of(len(ends)).alias("cls")), plain, total, "left")
    marked = marked.select("doc_id", "part", (F.col("bits") + copy).alias("bits"), "cls")
    different = classes.where("texts > 1").select("cls")
    if different.isEmpty():
        return marked.drop("cls")
    # Different texts with all hashes equal: their rows are told apart by the texts themselves.
    again = docs.withColumn("length", F.length("text")).withColumn("hashes", block_hashes(F.col("text"), ends))
    again = again.withColumn("cls", class_of(len(ends))).join(different, "cls", "left_semi").join(texts.select("cls", "text", "least"), ["cls", "text"])
    again = again.select("doc_id", "part", (text_faults(F.col("text")) + copy).alias("bits"))
    return marked.join(different, "cls", "left_anti").drop("cls").unionByName(again)


def fault_counts(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic) of (doc_id, part, bits) and labels (doc_id, quality, toxic)."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    # Rows of null id have no label: they don't go through the join, where they would meet in one task.
    labelled = marked.where("doc_id IS NOT NULL").join(known, "doc_id", "left").unionByName(marked.where("doc_id IS NULL"), allowMissingColumns=True)
    return labelled.groupBy("part", "bits").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def by_order(counts: DataFrame) -> DataFrame:
    """Every order and step of the filters per part, from the counts per set of bits."""
    bit = lambda i: F.pow(F.lit(2), F.ascii(F.substr(F.col("filter_order"), i, F.lit(1))) - ord(LETTERS[0])).cast("int")
    # One row per part holds its counts, of at most 32 sets of bits; the orders and steps are constant.
    table = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("sets"))
    table = table.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(LETTERS)])))
    table = table.withColumn("each", F.transform(F.sequence(F.lit(1), F.lit(len(LETTERS))), bit)).select("*", F.posexplode("each").alias("at", "own"))
    table = table.withColumn("step", F.col("at") + 1).withColumn("earlier", F.aggregate(F.slice("each", F.lit(1), F.col("at")), F.lit(0), Column.__add__))
    own, earlier = F.col("own"), F.col("earlier")
    total = lambda field, holds: F.aggregate(F.filter("sets", holds), F.lit(0).cast("long"), lambda s, x: s + x[field])
    gone = lambda x: x["bits"].bitwiseAND(earlier) > 0
    fails = lambda x: x["bits"].bitwiseAND(own) > 0
    here = lambda x: fails(x) & ~gone(x)
    rows = table.select(
        "part", "filter_order", "step", "own",
        total("n", lambda x: ~fails(x) & ~gone(x)).alias("kept"), total("n", here).alias("removed"), total("n", lambda x: fails(x) & gone(x)).alias("redundant"),
        total("n", lambda x: x["bits"] == own).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    )
    shapley = rows.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "own"]).select("part", "filter_order", "step", *COUNTS)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Per part, order and step of the filters A to E: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    counts = fault_counts(with_copies(own), labels)
    return by_order(common.written(counts, "audit-counts"))


def audit_sql() -> str:
    """The same over documents and labels in DuckDB's SQL."""
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(LETTERS))
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    return rf"""
    WITH base AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    worded AS (SELECT *, {words} AS w FROM base),
    known AS (SELECT doc_id AS d, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
    failing AS (
        SELECT b.part, coalesce(k.good, 0) AS good, coalesce(k.bad, 0) AS bad,
            (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
            || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
            || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
            || (CASE WHEN b.doc_id > min(b.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS f
        FROM worded b LEFT JOIN known k ON b.doc_id = k.d),
    sets AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failing GROUP BY part, f),
    steps AS (SELECT o AS filter_order, i AS step, substr(o, i, 1) AS own, substr(o, 1, i - 1) AS earlier FROM (VALUES {orders}) v(o), range(1, 6) r(i)),
    judged AS (
        SELECT s.*, x.*, contains(f, own) AS fails, earlier <> '' AND regexp_matches(f, '[' || earlier || 'x]') AS gone
        FROM sets s, steps x),
    counted AS (
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
            coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
            coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (f = own), 0) AS unique_fails,
            coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(bad) FILTER (fails AND NOT gone), 0) AS toxic_lost
        FROM judged GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM counted
    """
