"""Rows of disclosures as edges: holders, executives, investments, bulk holdings, supply contracts.

Each function is one projection, with at most one aggregate per holder; all runs in built-in functions. Rows carry
`corp`, the firm that files, `doc`, the receipt, and `day`, the date that the figures are of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

#: Signs of a firm's or body's name, of sums in tables, of common stock, of a top position.
FIRM_MARKS = ("㈜", "(주)", "(유)", "주식회사", "유한회사", "회사", "재단", "조합", "홀딩스", "그룹")
SUM_ROWS = ("계", "합계")
COMMON_STOCK = ("보통", "의결권")
TOP_POSITIONS = ("대표", "회장", "사장")
#: Counterparties that are no names.
NO_COUNTERPARTY = ("비공개", "기재생략", "기재 생략", "영업기밀", "영업 기밀", "제조사", "고객사", "거래처", "수요처", "매입처", "구매처", "발주처", "발주사", "복수", "관련업체", "관련 업체", "대형기업", "대형업체", "선주", "수요자", "고객", "매출액", "기재", "요청", "동의", "보호", "영업비밀", "중에서", "관련하여", "해당", "당사", "예정", "협의")
LEAST_PERSON_PERCENT, SUBSIDIARY_PERCENT, NEW_MONTHS, LONGEST_NAME = 5.0, 50.0, 12, 60


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    found = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(c, F.lit(p))
    return F.coalesce(found, F.lit(False))


def is_firm(name: Column) -> Column:
    return _any(name, FIRM_MARKS) | F.coalesce(name.rlike(r"(?i)[\s,.](" + "|".join((*T.ENGLISH_FORMS, "holdings", "holding")) + r")\.?$"), F.lit(False))


def primary_rows(rows: DataFrame, keys: list[str], stock: str, percent: str, place: str) -> DataFrame:
    """Of the rows of one holder that of common stock, then of the largest share, then the first; `others` lists the rest."""
    best = F.struct(_any(F.col(stock), COMMON_STOCK).alias("a"), F.coalesce(F.col(percent), F.lit(0.0)).alias("b"), (-F.col(place)).alias("c"))
    kept = [c for c in rows.columns if c not in keys]
    every = F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.concat_ws(" ", F.coalesce(stock, F.lit("")), F.concat(F.coalesce(percent, F.lit(0.0)).cast("string"), F.lit("%"))).alias("said"))))
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), best).alias("r"), every.alias("all"))
    others = F.filter("all", lambda x: x["at"] != F.col(f"r.{place}"))
    return g.select(*keys, *[F.col(f"r.{c}").alias(c) for c in kept], F.array_join(F.transform(others, lambda x: x["said"]), " · ").alias("others"))


def holder_edges(rows: DataFrame) -> DataFrame:
    """OWNS_STAKE_IN from rows (corp, name, relation, stock, percent, percent_before, shares, shares_before, doc, day, place).

    Sums go. A person stays with 5 percent or more, or if the relation is that of the controlling holder; firms stay.
    """
    r = rows.withColumn("name", T.collapse(F.col("name"))).where(F.col("name").isNotNull() & ~F.col("name").isin(*SUM_ROWS))
    r = primary_rows(r, ["corp", "name"], "stock", "percent", "place")
    flat = F.regexp_replace(F.coalesce("relation", F.lit("")), r"\s+", "")
    firm = is_firm(F.col("name"))
    kept = firm | (F.coalesce("percent", F.lit(0.0)) >= LEAST_PERSON_PERCENT) | F.contains(flat, F.lit("최대주주")) | (flat == "본인")
    major = (flat == "") | F.contains(flat, F.lit("본인")) | (flat == "최대주주")
    change = F.col("shares") - F.col("shares_before")
    return r.where(kept).select(
        F.when(firm, T.company_key(F.col("name"))).otherwise(F.concat_ws("@", "name", "corp")).alias("src"), F.col("corp").alias("tgt"), F.lit("OWNS_STAKE_IN").alias("type"),
        F.when(major, "최대주주").otherwise("특수관계인").alias("subtype"), F.when(firm, "Company").otherwise("Person").alias("src_label"),
        "percent", F.round(F.col("percent") - F.col("percent_before"), 2).alias("percent_change"), "shares", change.alias("shares_change"), F.coalesce(change != 0, F.lit(False)).alias("changed"), "others", "doc", "day",
    )


def executive_edges(rows: DataFrame) -> DataFrame:
    """IS_EXECUTIVE_OF from rows (corp, name, registered, position, birth, tenure, career, doc, day).

    Registered officers and top positions stay. A career's items begin at line breaks that are not indented, at
    bullets, and before the marks of present, former and second posts.
    """
    registered = T.clean_missing(F.col("registered"))
    top = _any(F.col("position"), TOP_POSITIONS)
    r = rows.withColumn("name", T.collapse(F.col("name"))).where(F.col("name").isNotNull() & (F.coalesce(registered != "미등기", F.lit(False)) | top))
    birth, months = V.korean_date(F.col("birth")), V.tenure_months(F.col("tenure"))
    whole = F.regexp_replace(T.clean_missing(F.col("career")), r"\n[ \t]+", " ")
    items = F.array_compact(F.transform(F.split(whole, r"\n|ㆍ|(?=\((?:현|전|겸)\))"), lambda x: T.collapse(x)))
    position = F.regexp_replace(T.clean_missing(F.col("position")), r"\s+", "")
    return r.select(
        F.when(birth.isNotNull(), F.concat_ws("|", "name", birth)).otherwise(F.concat_ws("@", "name", "corp")).alias("src"), F.col("corp").alias("tgt"), F.lit("IS_EXECUTIVE_OF").alias("type"),
        F.when(registered == "사외이사", "사외이사").otherwise(position).alias("subtype"), position.alias("position"), months.alias("tenure_months"), (months < NEW_MONTHS).alias("is_new"), F.nullif(F.array_join(items, " | "), F.lit("")).alias("career"), "doc", "day",
    )


def investment_edges(rows: DataFrame) -> DataFrame:
    """OWNS_STAKE_IN from rows (corp, name, percent, percent_before, acquired, doc, day): above half it is a subsidiary."""
    r = rows.withColumn("name", T.collapse(F.col("name"))).where(F.col("name").isNotNull() & ~F.col("name").isin(*SUM_ROWS))
    now, before = F.col("percent"), F.col("percent_before")
    return r.select(
        F.col("corp").alias("src"), T.company_key(F.col("name")).alias("tgt"), F.lit("OWNS_STAKE_IN").alias("type"), F.when(now > SUBSIDIARY_PERCENT, "자회사").otherwise("출자").alias("subtype"),
        "percent", F.round(now - before, 2).alias("percent_change"), (now > before).alias("increased"), (now < before).alias("decreased"), V.dotted_date(F.col("acquired")).alias("valid_from"), "doc", "day",
    )


def bulk_edges(rows: DataFrame) -> DataFrame:
    """OWNS_STAKE_IN from rows (corp, name, percent, reported, reason, doc, place): each reporter's latest, the first of equals."""
    r = rows.withColumn("name", T.collapse(F.col("name"))).where(F.col("name").isNotNull())
    newest = F.max_by(F.struct("percent", "reported", "reason", "doc"), F.struct(F.coalesce("reported", F.lit("")).alias("a"), (-F.col("place")).alias("b")))
    g = r.groupBy("corp", "name").agg(newest.alias("r"))
    day = F.coalesce(F.when(F.contains("r.reported", F.lit("-")), F.col("r.reported")), V.compact_date(F.col("r.reported")))
    src = F.when(is_firm(F.col("name")), T.company_key(F.col("name"))).otherwise(F.concat_ws("@", "name", "corp"))
    return g.select(src.alias("src"), F.col("corp").alias("tgt"), F.lit("OWNS_STAKE_IN").alias("type"), F.lit("5%이상주주").alias("subtype"), F.col("r.percent").alias("percent"), T.clean_missing(F.col("r.reason")).alias("reason"), day.alias("valid_from"), F.col("r.doc").alias("doc"))


def contract_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the fields of a supply contract's form; is_anonymous marks a counterparty that is not named."""
    d = V.once(docs, "_flat", F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))
    field = lambda p: F.nullif(F.regexp_extract("_flat", p, 1), F.lit(""))
    d = V.once(d, "_said", field(r"계약상대방?\s*(.+?)\s*-?\s*(?:최근\s*매출액|주요\s*사업|회사와의|계약내역|\d+\s*\.)"))
    d = V.once(d, "_bare", F.regexp_replace(F.trim(F.regexp_replace("_said", r"\(.*?\)", "")), r"^[-· ]+|[-· ]+$", ""))
    d = V.once(d, "_named", F.when((F.col("_bare") != "") & (F.length("_bare") <= LONGEST_NAME) & ~_any(F.col("_bare"), NO_COUNTERPARTY), F.col("_bare")))
    return d.withColumns({
        "counterparty": F.col("_named"), "is_anonymous": F.col("_said").isNotNull() & F.col("_named").isNull(), "amount": V.number(field(r"계약금액\(원\)\s*([\d,]+)"), "long"),
        "revenue_ratio": F.round(V.number(field(r"매출액대비\(%\)\s*([\d.]+)")) / 100, 4), "valid_from": field(r"계약기간\s*시작일\s*(\d{4}-\d{2}-\d{2})"),
        "valid_until": field(r"종료일\s*(\d{4}-\d{2}-\d{2})"), "occurred_at": field(r"계약\(수주\)일자\s*(\d{4}-\d{2}-\d{2})"),
    }).drop("_flat", "_said", "_bare", "_named")


def contract_edges(docs: DataFrame) -> DataFrame:
    """SUPPLIES_TO from docs (corp, doc, reported, place, text): the latest contract with each counterparty, the first of equals."""
    f = V.once(contract_fields(docs).where(F.col("counterparty").isNotNull()), "tgt", T.company_key(F.col("counterparty"))).where("tgt <> ''")
    what = F.struct("counterparty", "amount", "revenue_ratio", "valid_from", "valid_until", "occurred_at", "doc")
    g = f.groupBy("corp", "tgt").agg(F.max_by(what, F.struct(F.coalesce("reported", F.lit("")).alias("a"), (-F.col("place")).alias("b"))).alias("r"))
    return g.select(F.col("corp").alias("src"), "tgt", F.lit("SUPPLIES_TO").alias("type"), "r.*")
