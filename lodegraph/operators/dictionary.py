"""Names of a dictionary in texts: every place, the longest at each place, and whole words with particles behind.

Names meet texts in two steps. First the beginnings of the names, of BEGINNING letters, with the lengths of the names
that begin so, are looked for at every letter; where one stands, the words of these lengths are cut out. Then these are
joined with the names as equals. So a place meets no more words than there are lengths, however many names begin alike.

Beginnings and names are each broadcast up to MOST_BROADCAST; beyond, what is cut out is shuffled, and only with more
beginnings than that the pieces of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BROADCAST = 500_000
#: Letters of a name's beginning; a shorter name is its own.
BEGINNING = 4
#: Letters of a piece of text; what is around it goes along with each of its letters.
PIECE = 128
#: Particles that may stand behind a name within its word.
PARTICLES = ("으로부터", "에서는", "에서도", "에게서", "으로는", "이라는", "에서", "에게", "으로", "까지", "부터", "처럼", "보다", "마다", "라는", "에는", "에도", "와의", "과의", "이나", "에", "의", "은", "는", "이", "가", "을", "를", "와", "과", "도", "로", "만")


def named(names: DataFrame) -> DataFrame:
    """(code, name, len): each distinct name of two letters or more."""
    return names.where("code IS NOT NULL").select("code", "name", F.length("name").alias("len")).where("len >= 2").distinct()


def beginnings(known: DataFrame) -> DataFrame:
    """(gram, k, lens): what names begin with, its letters, and the lengths of the names that begin so."""
    k = F.least("len", F.lit(BEGINNING))
    return known.select(F.substr("name", F.lit(1), k).alias("gram"), k.alias("k"), "len").groupBy("gram", "k").agg(F.array_sort(F.collect_set("len")).alias("lens"))


def _piece(c: Column, pad: int) -> Column:
    """The c-th piece of text: its first and last letter, and what is around it, from the letter base on."""
    first, last = c * PIECE + 1, F.least((c + 1) * PIECE, F.col("n"))
    base = F.greatest(first - pad, F.lit(1))
    return F.struct(first.alias("first"), last.alias("last"), base.alias("base"), F.substr("text", base, last - base + 1 + pad).alias("around"))


def words(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(ident, start, len, name, after, previous): what stands in texts where a name may begin, in the lengths of such names."""
    begin = beginnings(known)
    n, most, ks = begin.agg(F.count("*"), F.max(F.array_max("lens")), F.sort_array(F.collect_set("k"))).first()
    # pieces of a text, each with enough letters before and behind it for the longest name and a particle
    pad = (most or 0) + max(map(len, PARTICLES)) + 2
    t = texts.where("text <> ''").select("ident", "text", F.length("text").alias("n"))
    each = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int")), lambda c: _piece(c, pad))
    pieces = t.select("ident", F.explode(each).alias("p")).select("ident", "p.*")
    # one row per letter and length of a beginning
    rows = pieces.select("ident", "base", "around", F.explode(F.sequence("first", "last")).alias("start"))
    at = F.col("start") - F.col("base") + 1  # in the letters around
    rows = rows.select("*", F.explode(F.array(*[F.lit(k) for k in ks or [0]])).alias("k")).withColumn("gram", F.substr("around", at, F.col("k")))
    met = rows.join(F.broadcast(begin) if n <= MOST_BROADCAST else begin, ["gram", "k"])
    met = met.select("ident", "start", "base", "around", F.explode("lens").alias("len")).withColumn("name", F.substr("around", at, F.col("len"))).where(F.length("name") == F.col("len"))
    after = F.regexp_extract(F.substr("around", at + F.col("len")), r"^([\p{L}\p{N}]*)", 1)
    return met.select("ident", "start", "len", "name", after.alias("after"), F.when(F.col("start") > 1, F.substr("around", F.greatest(at - 1, F.lit(1)), F.lit(1))).alias("previous"))


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(ident, start, len, code, name, after, previous): every place of every name in texts (ident, text).

    start counts from 1; after is what follows in its word, as far as a particle reaches, previous the letter before.

    A null or empty text has none; names under two letters are not looked for; equal names of several codes are found
    for each; repeated texts give repeated rows.
    """
    known = named(names)
    by_name = known.select("name", "code")
    few = by_name.count() <= MOST_BROADCAST
    found = words(texts, known).join(F.broadcast(by_name) if few else by_name, "name")
    return found.select("ident", "start", "len", "code", "name", "after", "previous")


def whole_words(found: DataFrame) -> DataFrame:
    """Occurrences that begin a word and go on to its end, but for a particle."""
    first = F.col("previous").isNull() | ~F.col("previous").rlike(r"[\p{L}\p{N}]")
    return found.where(first & ((F.col("after") == "") | F.col("after").isin(*PARTICLES)))


def longest(found: DataFrame) -> DataFrame:
    """(ident, start, len, code, name): from left to right the longest name at each place, none within or over another.

    Of equal names the least code. The places of one text meet in a row; texts are as long as articles.
    """
    one = found.groupBy("ident", "start").agg(F.min(F.struct((-F.col("len")).alias("n"), "code", "name")).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("start", (-F.col("m.n")).alias("len"), "m.code", "m.name")))
    kept = F.aggregate(ordered, F.struct(F.lit(1).alias("next"), F.slice(ordered, 1, 0).alias("kept")), _taken)["kept"]
    return one.groupBy("ident").agg(kept.alias("kept")).select("ident", F.inline("kept"))


def _taken(state: Column, m: Column) -> Column:
    take = m["start"] >= state["next"]
    return F.struct(F.when(take, m["start"] + m["len"]).otherwise(state["next"]).alias("next"), F.when(take, F.concat(state["kept"], F.array(m))).otherwise(state["kept"]).alias("kept"))
