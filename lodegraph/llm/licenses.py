"""Operator 8: licences by the digest of canonical text, in DataFrame functions only.

Canonical form: ASCII capitals become small, typographic quotes and dashes plain; statements of copyright go, and so
does "all rights reserved"; runs of ASCII other than letters and digits become one space; spellings that count as equal
become one. A statement of copyright is the word or sign with a year, or a place for one, and up to twenty words of
holders, which end with the paragraph, at the next statement, or where a licence's own sentence begins. So sentences
that speak of copyright, and list marks (c), stay, and no rule asks where a line breaks. The SHA-256 digest of that form
is joined with the digests of known licence texts.

Whole texts are joined as they are, and so are their units, where a notice or a licence stands in other text: every
stretch from the beginning of a line to the end of a line, hence lines, blocks and runs of either, that is as long as a
known text. The first characters of the known texts tell which texts can hold one at all, and lengths and line ends, as
keys of a join, which stretches can be one; only those are cut out and digested, once per distinct text. Every text is
put into canonical form once, and what follows reads the written result.

The table of known texts is broadcast up to MOST_BROADCAST rows, and joined by shuffling beyond.

Edge cases: a null text has a null digest and no licence; an empty canonical form is no licence; repeated rows each get
their row, with equal results; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common
from .license_texts import EQUIVALENT, KNOWN

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FANCY, _PLAIN = "“”„‘’–—‑", "\"\"\"''---"
#: Of a text in lower case: the head of a statement of copyright, and what begins a sentence behind one.
STATED = r"(?:copyright|©|\(c\))(?:\s*(?:copyright|©|\(c\)))*\s*(?:(?:19|20)\d\d(?:\s*[-,]\s*(?:19|20)\d\d)*|<year>|\[yyyy\]|19yy|yyyy)"
SENTENCES = r"permission\s+(?:is|to)|everyone\s+is|redistribution\s+and|(?:licensed|released|distributed)\s+under|under\s+the|this\s+(?:program|library|software|file|work|is|source)|you\s+(?:may|can|must)|spdx"
RESERVED = r"all\s+rights\s+reserved"
#: A mark ends a statement before it; another begins one. Both are punctuation, so none is left in the canonical form.
_END, _BEGIN = "\x01", "\x02"
STATEMENT = _BEGIN + STATED + rf"[^\s{_END}]*(?:(?:[ \t\r]*\n[ \t\r]*|[ \t\r]+)[^\s{_END}]+)" + "{0,20}" + rf"([ \t\r]*\n?[ \t\r]*{_END}|[ \t\r]*\n[ \t\r]*\n|[ \t\r]*\n?[ \t\r]*$)"
#: ASCII but letters, digits and the line feed.
PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"
#: The same runs but for single spaces, which stay as they are; so most of a text needs no replacement.
_RUNS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]{2,}|[\x00-\x09\x0b-\x1f\x21-\x2f\x3a-\x60\x7b-\x7f]"
#: Known texts up to which their table is broadcast, and up to which their beginnings, of so many characters, filter texts.
MOST_BROADCAST, MOST_HEADS, HEAD = 10_000, 200, 40


def rules() -> list[tuple[str, str]]:
    """(pattern, replacement with \\1) in order: marks, then what goes."""
    return [(f"({STATED})", f"{_END}{_BEGIN}\\1"), (f"({SENTENCES})", f"{_END}\\1"), (RESERVED, _END), (STATEMENT, "\\1")]


def spellings() -> list[tuple[str, str]]:
    """EQUIVALENT as (pattern, replacement with \\1) on lines: its spaces may be line feeds, which stay, before a word that becomes one of two."""
    out = []
    for spelling, same in EQUIVALENT:
        if " " not in spelling or " " in same:
            out.append((spelling.replace(" ", "( ?\\n ?| )"), same.replace(" ", "\\1")))
        else:
            out += [(spelling, same), (spelling.replace(" ", "( ?\\n ?)"), "\\1" + same)]
    return out


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line feeds."""
    # Of ASCII alone, lower() does the same and is far cheaper.
    c = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER + _FANCY, _LOWER + _PLAIN))
    java = lambda replacement: replacement.replace("\\1", "$1")
    stated = c
    for pattern, replacement in rules():
        stated = F.regexp_replace(stated, pattern, java(replacement))
    c = F.when(c.rlike("copyright|©|[(]c[)]|reserved"), stated).otherwise(c)
    c = F.regexp_replace(c, _RUNS, " ")
    for pattern, same in spellings():
        c = F.regexp_replace(c, pattern, java(same)) if "(" in pattern else F.replace(c, F.lit(pattern), F.lit(same))
    return c


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]{2,}|\n", " "))


def canonical(text: str) -> str:
    """The same of a Python string, for the table of known texts."""
    c = text.translate(str.maketrans(_UPPER + _FANCY, _LOWER + _PLAIN))
    for pattern, replacement in rules():
        c = re.sub(pattern, replacement, c)
    c = re.sub(PUNCTUATION, " ", c)
    for pattern, same in spellings():
        c = re.sub(pattern, same, c)
    return re.sub(r"[ \n]+", " ", c).strip(" ")


def known_table(known: list[tuple[str, str]] = KNOWN) -> list[tuple[str, str, int]]:
    """(licence, digest, canonical length), one row per digest."""
    found = {canonical(text): name for name, text in known}
    return sorted((name, hashlib.sha256(c.encode()).hexdigest(), len(c)) for c, name in found.items() if c)


def held_lengths(text: Column, known: list[tuple[str, str]]) -> Column:
    """The lengths of the known texts whose beginning the canonical text holds."""
    by_head: dict[str, set[int]] = {}
    for c in {canonical(t) for _, t in known} - {""}:
        by_head.setdefault(c[:HEAD], set()).add(len(c))
    if not by_head or len(by_head) > MOST_HEADS:
        lengths = sorted(set().union(*by_head.values())) if by_head else []
        return F.array(*map(F.lit, lengths)).cast("array<int>")
    none = F.array().cast("array<int>")
    return F.array_distinct(F.concat(*[F.when(text.contains(head), F.array(*map(F.lit, sorted(n)))).otherwise(none) for head, n in sorted(by_head.items())]))


def units(hits: DataFrame) -> DataFrame:
    """(digest, h, known): the digests of the stretches of lines, in hits (digest, h, c, n, lengths), that are as long as a known text."""
    own = ["digest", "h"]
    lines = hits.select(*own, "n", "lengths", F.posexplode(F.split("c", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    end = F.sum(F.length("line") + 1).over(W.partitionBy(*own).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)) - 1
    lines = lines.select(*own, "n", "lengths", end.alias("end"), F.length("line").alias("size"))
    starts = lines.select(*own, "n", "end", "size", F.explode("lengths").alias("length")).where("length < n")
    starts = starts.select(*own, (F.col("end") - F.col("size") + F.col("length")).alias("end"), "length")
    places = starts.join(lines.select(*own, "end"), [*own, "end"]).groupBy(*own).agg(F.collect_set(F.struct((F.col("end") - F.col("length")).cast("int").alias("at"), "length")).alias("places"))
    texts = hits.select(*own, whole(F.col("c")).alias("t")).join(places, own)
    return texts.select(*own, F.explode(F.array_distinct(F.transform("places", lambda p: F.sha2(F.substring(F.col("t"), p["at"] + 1, p["length"]), 256)))).alias("known"))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """Per row of docs: doc_id, digest, license (of the whole text), notices (of stretches of lines, sorted), n_notices."""
    table = known_table(known)
    names = docs.sparkSession.createDataFrame(table, "name string, known string, n int").select("name", "known")
    names = F.broadcast(names) if len(table) <= MOST_BROADCAST else names
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.col("text")).alias("c")).withColumn("t", whole(F.col("c")))
    text = text.withColumn("lengths", held_lengths(F.col("t"), known))
    rows = text.select("doc_id", F.sha2("t", 256).alias("digest"), F.xxhash64("c").alias("h"), F.length("t").alias("n"), "lengths", F.when(F.size("lengths") > 0, F.col("c")).alias("c"))
    rows = common.written(rows, "license-texts")
    hits = rows.where(F.size("lengths") > 0).select("digest", "h", "n", "lengths", "c").dropDuplicates(["digest", "h"])
    notices = units(hits).join(names, "known").groupBy("digest", "h").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices"), F.count_distinct("known").alias("n_notices"))
    out = rows.select("doc_id", "digest", "h").join(notices, ["digest", "h"], "left").join(names.withColumnsRenamed({"known": "digest", "name": "license"}), "digest", "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def scan_sql(known: list[tuple[str, str]] = KNOWN) -> str:
    """The same over the table documents in DuckDB's SQL, from the known texts and not from scan()."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, {quote(c)})" for c, name in {canonical(t): n for n, t in known}.items() if c)
    c = f"translate(text, {quote(_UPPER + _FANCY)}, {quote(_LOWER + _PLAIN)})"
    for pattern, replacement in rules():
        c = f"regexp_replace({c}, {quote(pattern)}, {quote(replacement)}, 'g')"
    c = f"regexp_replace({c}, {quote(PUNCTUATION)}, ' ', 'g')"
    for pattern, same in spellings():
        c = f"regexp_replace({c}, {quote(pattern)}, {quote(same)}, 'g')"
    return f"""
    WITH known(name, text) AS (VALUES {values}),
    base AS (SELECT doc_id, {c} AS c FROM documents),
    texts AS (SELECT doc_id, c, trim(regexp_replace(c, '[ \\n]+', ' ', 'g'), ' ') AS t FROM base),
    split AS (SELECT doc_id, t, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, t, string_split(c, chr(10)) AS l FROM texts WHERE c IS NOT NULL)),
    lines AS (
        SELECT doc_id, t, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS stop
        FROM (SELECT doc_id, t, trim(regexp_replace(line, ' +', ' ', 'g'), ' ') AS line, i FROM split) WHERE line <> ''),
    stretches AS (
        SELECT a.doc_id, k.name, k.text, a.stop - length(a.line) + length(k.text) AS stop
        FROM lines a JOIN known k ON length(k.text) < length(a.t) AND substr(a.t, CAST(a.stop - length(a.line) + 1 AS BIGINT), length(k.text)) = k.text),
    notices AS (
        SELECT s.doc_id, string_agg(DISTINCT s.name, ',' ORDER BY s.name) AS notices, count(DISTINCT s.text) AS n_notices
        FROM stretches s JOIN lines z ON s.doc_id = z.doc_id AND s.stop = z.stop GROUP BY s.doc_id)
    SELECT x.doc_id, sha256(x.t) AS digest, k.name AS license, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n_notices, 0) AS BIGINT) AS n_notices
    FROM texts x LEFT JOIN known k ON x.t = k.text LEFT JOIN notices n ON x.doc_id = n.doc_id
    """
