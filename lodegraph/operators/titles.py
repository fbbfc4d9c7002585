"""Titles of executives from the evidence of their posts: behind the name, in this firm, and held now.

A title is looked for right behind the full name. A former title is passed over, and one that stands behind another firm's name
belongs to that firm. Where a text calls a person by the family name alone, that counts only if the full name and the
firm are in the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionary

#: Titles in order of precedence, the one that some are shown as, and what a post has that says nothing.
TITLES = ("대표이사", "부회장", "회장", "부사장", "사장", "사외이사", "사내이사", "기타비상무이사", "전무이사", "상무이사", "전무", "상무", "감사위원", "감사", "최고경영자", "최고기술책임자", "최고재무책임자", "최고운영책임자", "최고전략책임자", "최고정보책임자", "CEO", "CTO", "CFO", "COO", "CSO", "CIO", "창업자", "설립자", "의장", "고문", "부문장", "본부장", "센터장", "연구소장", "공동대표", "각자대표", "대표", "이사")
SHOWN = {"최고경영자": "CEO", "최고기술책임자": "CTO", "최고재무책임자": "CFO", "최고운영책임자": "COO", "최고전략책임자": "CSO", "최고정보책임자": "CIO", "전무이사": "전무", "상무이사": "상무", "감사위원": "감사", "설립자": "창업자", "공동대표": "대표", "각자대표": "대표"}
VAGUE = ("", "임원", "기타", "OTHER", "other")
_ANY = "|".join(TITLES)
_BEHIND = rf"\s*([^.。\n]{{0,20}}?)({_ANY})"
FORMER = r"(^|\s)(전|前)\s"


def firm_key(c: Column) -> Column:
    """A firm's name for comparison within a text: no space, brackets or signs of its legal form, small letters."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s()（）㈜주]|주식회사", ""))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("")), F.lit("\\E"))


def titles_from_evidence(posts: DataFrame, evidence: DataFrame, firms: DataFrame) -> DataFrame:
    """(edge_id, title, evidence_id): the title of posts (edge_id, person, company, subtype, evidence_ids) that have none, where their evidence shows one.

    evidence (evidence_id, text), one row per id; firms (name) are all firms, to tell whose a title is. Ids are read in
    their order, and in a text what stands behind the full name before the family name alone. Posts without a person,
    an evidence with a text, or a title found have no row. A firm's key of one letter is not looked for.
    """
    vague = F.coalesce("subtype", F.lit("")).isin(*VAGUE) & (F.coalesce("person", F.lit("")) != "")
    cited = posts.where(vague).select("edge_id", "person", firm_key(F.col("company")).alias("own"), F.posexplode(F.array_distinct("evidence_ids")).alias("nth", "evidence_id"))
    rows = cited.join(evidence.where("text <> ''").select("evidence_id", "text"), "evidence_id")
    # every place where the name has a title behind it, in order
    pattern = F.concat(_quoted(F.col("person")), F.lit(_BEHIND))
    found = rows.select("edge_id", "nth", "evidence_id", "own", F.posexplode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("at", "hit"), "person")
    part = lambda k: F.regexp_extract(F.substr("hit", F.length("person") + 1), "^" + _BEHIND, k)
    found = found.select("edge_id", "nth", "evidence_id", "own", "at", part(1).alias("gap"), part(2).alias("title")).where(~F.col("gap").rlike(FORMER))
    found = found.withColumn("gap", firm_key(F.col("gap")))
    names = firms.where("length(name) >= 2").select(firm_key(F.col("name")).alias("name")).distinct().select(F.col("name").alias("code"), "name")
    gaps = found.where("gap <> ''").select(F.col("gap").alias("ident"), F.col("gap").alias("text")).distinct()
    named = dictionary.occurrences(gaps, names).groupBy(F.col("ident").alias("gap")).agg(F.collect_set("name").alias("named"))  # of twenty letters
    judged = found.join(named, "gap", "left")
    other = F.coalesce(F.exists("named", lambda n: (F.col("own") == "") | (n != F.col("own"))), F.lit(False)) & ((F.col("own") == "") | ~F.contains("gap", "own"))
    behind = judged.where(~other).select("edge_id", "nth", F.lit(0).alias("way"), "at", "title", "evidence_id")
    # the family name alone, in a text that also has the full name and the firm
    alone = rows.where((F.length("person") >= 2) & F.contains("text", F.col("person")) & ((F.col("own") == "") | F.contains(firm_key(F.col("text")), F.col("own"))))
    short = F.concat(F.lit("(?<![가-힣])"), _quoted(F.substring("person", 1, 1)), F.lit(rf"\s({_ANY})"))
    alone = alone.select("edge_id", "nth", F.lit(1).alias("way"), F.lit(0).alias("at"), F.get(F.regexp_extract_all("text", short, F.lit(1)), F.lit(0)).alias("title"), "evidence_id").where("title IS NOT NULL")
    first = behind.unionByName(alone).groupBy("edge_id").agg(F.min(F.struct("nth", "way", "at", "title", "evidence_id")).alias("f"))
    shown = F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair])
    return first.select("edge_id", F.coalesce(F.try_element_at(shown, F.col("f.title")), F.col("f.title")).alias("title"), F.col("f.evidence_id").alias("evidence_id"))
