"""Disclosures as rows and edges: which filings count, mergers, lawsuits, products, contracts, sentences, repairs of firms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S
from ..functions import text as T
from ..functions import values as V

#: Words of titles that are no annual reports, marks of partial amendments, and of nameless opponents.
NOT_ANNUAL = ("반기", "분기", "해외증권거래소", "국내신고")
PARTIAL_AMENDMENT = ("[첨부정정]", "[첨부추가]")
ANONYMOUS = ("OO", "○○", "외 ", "개인", "비공개")
#: What an edge claims, with both roles named.
CLAIMS = {
    "SUPPLIES_TO": "파는 쪽(공급사)은 {a}이고, 사는 쪽(고객)은 {b}이다",
    "OWNS_STAKE_IN": "주주는 {a}이고, 지분이 보유된 회사는 {b}이다",
    "IS_EXECUTIVE_OF": "{a}은(는) {b}의 임원이다",
    "ACQUIRES": "인수하는 쪽은 {a}이고, 인수당하는 쪽은 {b}이다",
    "SUES": "제소한 쪽(원고)은 {a}이고, 피소된 쪽(피고)은 {b}이다",
    "REGULATES": "규제·수사·감독하는 쪽은 {a}이고, 대상 기업은 {b}이다",
    "PARTNERS_WITH": "{a}과(와) {b}이(가) 서로 협력한다(합작·공동개발·제휴)",
    "COMPETES_WITH": "{a}과(와) {b}이(가) 같은 제품·시장에서 경쟁한다",
    "DEVELOPS": "{a}이(가) 「{b}」을(를) 직접 개발·생산한다",
    "DEPENDS_ON": "{a}이(가) 「{b}」 없이는 안 될 만큼 의존한다",
    "HAS_EVENT": "{a}이(가) 「{b}」 사건의 당사자다",
    "IMPACTS": "「{a}」 사건이 {b}에 영향을 미친다",
}


def holds_any(c: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def annual_reports(filings: DataFrame) -> DataFrame:
    """(corp, rcept_no): the newest annual report of each firm in filings (corp, rcept_no, title, filed); a partial amendment only if there is no other."""
    annual = filings.where(F.contains("title", F.lit("사업보고서")) & ~holds_any(F.col("title"), NOT_ANNUAL))
    best = F.struct((~holds_any(F.col("title"), PARTIAL_AMENDMENT)).alias("whole"), "filed", "rcept_no")
    return annual.groupBy("corp").agg(F.max_by("rcept_no", best).alias("rcept_no"))


def supply_filings(filings: DataFrame) -> DataFrame:
    """Filings of supply contracts that are not about their end."""
    return filings.where(F.contains("title", F.lit("공급계약")) & ~F.contains("title", F.lit("해지")))


def sections(reports: DataFrame) -> DataFrame:
    """(rcept_no, title, body) of reports (rcept_no, xml): each titled section up to the next title, numbering and brackets off, a title's first sight counting."""
    parts = F.regexp_extract_all("xml", F.lit(r"(?is)(<TITLE[^>]*>.*?</TITLE>(?:(?!<TITLE).)*)"), 1)
    rows = reports.select("rcept_no", F.posexplode(parts).alias("pos", "part"))
    title = T.strip_markup(F.regexp_extract("part", r"(?is)<TITLE[^>]*>(.*?)</TITLE>", 1))
    title = F.trim(F.regexp_replace(F.regexp_replace(title, r"^\s*(?:[IVXⅠ-Ⅻ]+|\d+|[가-하])(?:-\d+)*[.)]\s*", ""), r"[\[\]【】()]", ""))
    rows = rows.select("rcept_no", "pos", title.alias("title"), T.strip_markup(F.regexp_replace("part", r"(?is)<TITLE[^>]*>.*?</TITLE>", "")).alias("body")).where("title <> ''")
    first = F.row_number().over(W.partitionBy("rcept_no", "title").orderBy("pos"))
    return rows.withColumn("_r", first).where("_r = 1").select("rcept_no", "title", "body")


def target_sections(found: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(rcept_no, kind, body): of each wanted kind the section whose title, without spaces, holds the given words; the least title of several."""
    name = F.coalesce(*[F.when(F.contains(F.replace("title", F.lit(" "), F.lit("")), F.lit(words)), F.lit(kind)) for kind, words in wanted.items()])
    return found.withColumn("kind", name).where("kind is not null").groupBy("rcept_no", "kind").agg(F.min_by("body", "title").alias("body"))


def acquisitions(rows: DataFrame) -> DataFrame:
    """ACQUIRES edges of reports (corp, kind, target, decided, rate): mergers and bought shares; a firm's own name and missing names go."""
    target = F.nullif(F.trim(F.regexp_replace(T.clean_name(F.col("target")), r"\(.*?\)", "")), F.lit(""))
    e = rows.withColumn("target", target).withColumn("tgt", T.company_key(F.col("target"))).where("target is not null and tgt <> corp and kind in ('merger', 'shares')")
    subtype = F.when(F.col("kind") == "merger", "합병").otherwise("주식취득")
    return e.select(F.col("corp").alias("src"), "tgt", F.lit("ACQUIRES").alias("type"), subtype.alias("subtype"), V.korean_date(F.col("decided")).alias("occurred_at"), F.when(F.col("kind") == "shares", V.number(F.col("rate"))).alias("rate"))


def lawsuits(rows: DataFrame, firms: DataFrame) -> DataFrame:
    """Edges of lawsuits (corp, rcept_no, case_name, opponent, filed): opponent SUES firm if the opponent is a known firm, else HAS_EVENT.

    firms (key, name) resolves opponents by the key of their name; a name of two firms, or a nameless one, resolves to none.
    """
    known = firms.groupBy(T.company_key(F.col("name")).alias("k")).agg(F.min("key").alias("opp"), F.count_distinct("key").alias("n")).where("n = 1").drop("n")
    named = F.when(~holds_any(F.col("opponent"), ANONYMOUS), T.company_key(F.col("opponent")))
    j = rows.withColumn("opponent", T.clean_missing(F.col("opponent"))).withColumn("k", named).join(known, "k", "left")
    case, event = F.coalesce(T.clean_missing(F.col("case_name")), F.lit("소송")), F.concat(F.lit("evt_"), "rcept_no")
    sues = F.col("opp").isNotNull()
    return j.select(F.when(sues, F.col("opp")).otherwise(F.col("corp")).alias("src"), F.when(sues, F.col("corp")).otherwise(event).alias("tgt"), F.when(sues, "SUES").otherwise("HAS_EVENT").alias("type"), F.when(sues, case).otherwise("소송").alias("subtype"), V.korean_date(F.col("filed")).alias("occurred_at"))


def product_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", ""))


def product_edges(rows: DataFrame) -> DataFrame:
    """DEVELOPS edges (src, tgt, subtype) of products (corp, name, category) whose key has two letters or more."""
    e = rows.select(F.col("corp").alias("src"), product_key(F.col("name")).alias("tgt"), F.coalesce("category", F.lit("제품")).alias("subtype"))
    return e.where("length(tgt) >= 2").distinct()


def contract_edges(rows: DataFrame) -> DataFrame:
    """Edges (src, tgt, type, subtype) of contracts (corp, counterparty, edge_type, direction, subtype).

    Supply runs from supplier to customer, whichever of them reports; partners stand in order of keys; what a firm
    depends on is a product. A firm's own name goes.
    """
    other = F.when(F.col("edge_type") == "DEPENDS_ON", product_key(F.col("counterparty"))).otherwise(T.company_key(F.col("counterparty")))
    e = rows.withColumn("other", other).where("trim(counterparty) <> '' and edge_type in ('SUPPLIES_TO', 'PARTNERS_WITH', 'DEPENDS_ON')")
    e = e.where("case when edge_type = 'DEPENDS_ON' then length(other) >= 2 else other <> corp end")
    turned = ((F.col("edge_type") == "SUPPLIES_TO") & F.coalesce(F.col("direction") == "they_supply", F.lit(False))) | ((F.col("edge_type") == "PARTNERS_WITH") & (F.col("corp") > F.col("other")))
    return e.select(F.when(turned, F.col("other")).otherwise(F.col("corp")).alias("src"), F.when(turned, F.col("corp")).otherwise(F.col("other")).alias("tgt"), F.col("edge_type").alias("type"), F.coalesce("subtype", F.lit("")).alias("subtype"))


def claim_sentence(kind: Column, a: Column, b: Column) -> Column:
    """What an edge claims, as a sentence; a missing name is a question mark."""
    texts = F.create_map(*[F.lit(x) for pair in CLAIMS.items() for x in pair])
    other = F.concat(F.lit("{a}과(와) {b}이(가) "), kind, F.lit(" 관계다"))
    name = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    return F.concat(F.replace(F.replace(F.coalesce(F.element_at(texts, kind), other), F.lit("{a}"), name(a)), F.lit("{b}"), name(b)), F.lit("."))


def stake_sentence(src: Column, tgt: Column, subtype: Column, ratio: Column, previous: Column, day: Column) -> Column:
    """The evidence sentence of a stake: role, share, what it was before if it differs, the day."""
    topic = F.concat(src, F.when(T.final_letter(src), "은").otherwise("는"))
    share = F.coalesce(F.concat(ratio.cast("string"), F.lit("%")), F.lit("비공개"))
    first = F.concat(topic, F.lit(" "), tgt, F.lit("의 "), F.coalesce(subtype, F.lit("지분")), F.lit("로 지분 "), share, F.lit("를 보유하고 있다."))
    moved = F.when(previous != ratio, F.concat(F.lit("직전 지분율 "), previous.cast("string"), F.lit("%에서 변동되었다.")))
    return F.concat_ws(" ", first, moved, F.concat(F.lit("기준일 "), day, F.lit(".")))


def stake_faults(rows: DataFrame) -> DataFrame:
    """rows with `faults`: the names of the rules that a stake breaks; rows without any are kept, the others dropped."""
    within = lambda c, low, high: F.col(c).isNotNull() & ~F.col(c).between(low, high)
    rules = {"ratio": within("ratio", 0, 100), "previous_ratio": within("previous_ratio", 0, 100), "share_count": F.col("share_count") < 0, "settlement_date": F.col("settlement_date").isNotNull() & ~F.col("settlement_date").rlike(r"^\d{4}-\d{2}-\d{2}$")}
    return rows.withColumn("faults", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))


def post_faults(rows: DataFrame, today: str) -> DataFrame:
    """rows with `faults` (dropped) and `birth_odd` (kept, with a warning): tenure up to 1200 months, days as ISO dates, births from 1900 to this year."""
    tenure = F.col("tenure_months").isNotNull() & ~F.col("tenure_months").between(0, 1200)
    day = F.col("settlement_date").isNotNull() & ~F.col("settlement_date").rlike(r"^\d{4}-\d{2}-\d{2}$")
    year = F.regexp_extract("birth", r"^(\d{4})-\d{2}$", 1).try_cast("int")
    odd = F.col("birth").isNotNull() & ~F.coalesce(year.between(1900, int(today[:4])), F.lit(False))
    return rows.withColumn("faults", F.array_compact(F.array(F.when(tenure, F.lit("tenure_months")), F.when(day, F.lit("settlement_date"))))).withColumn("birth_odd", odd)


def registry_fill(companies: DataFrame, registry: DataFrame) -> DataFrame:
    """companies (key, corp_code, name, induty) with what they lack from registry (corp_code, name, induty): by code, else by a name that is one firm's."""
    by_code = registry.groupBy("corp_code").agg(F.min("induty").alias("_i1"))
    by_name = registry.groupBy(T.company_key(F.col("name")).alias("_k")).agg(F.min("corp_code").alias("_c2"), F.min("induty").alias("_i2"), F.count_distinct("corp_code").alias("_n")).where("_n = 1").drop("_n")
    j = companies.join(by_code, "corp_code", "left").withColumn("_k", T.company_key(F.col("name"))).join(by_name, "_k", "left")
    return j.select("key", F.coalesce("corp_code", "_c2").alias("corp_code"), "name", F.coalesce("induty", "_i1", "_i2").alias("induty"))


def investee_figures(stakes: DataFrame, figures: DataFrame) -> DataFrame:
    """(src, tgt, total_assets): a firm's figures go to its stake edge if that is its only one; else their source is unknown and they go."""
    one = stakes.groupBy("tgt").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1")
    return one.join(figures, "tgt").select("src", "tgt", "total_assets")


def five_percent_faults(stakes: DataFrame, *, least: float = 5.0) -> DataFrame:
    """(tgt, total): firms whose holders under the five percent rule together hold less than that."""
    total = stakes.where("holder_kind = 'bulk'").groupBy("tgt").agg(F.sum(F.col("ratio").cast("decimal(18,4)")).alias("total"))
    return total.where(F.col("total") < least).select("tgt", F.col("total").cast("double").alias("total"))


def product_keepers(products: DataFrame, by=T.compact) -> DataFrame:
    """(old, keep): products (key, name, degree) of one canonical key join the one of highest degree, the least key of equals."""
    p = products.withColumn("k", by(F.col("name"))).where("k <> ''")
    g = p.groupBy("k").agg(F.min_by("key", F.struct((-F.col("degree")).alias("d"), F.col("key"))).alias("keep"), F.count("*").alias("n")).where("n > 1")
    return p.join(g, "k").where("key <> keep").select(F.col("key").alias("old"), "keep")


def type_verdicts(edges: DataFrame, nodes: DataFrame, ident: Column | None = None) -> DataFrame:
    """(edge_id, verdict): what an edge's asked type allows between its ends: forward, reverse, judge (a direction must be chosen) or keep.

    edges have type and asked; a symmetric edge that becomes a directed one needs a judge. Of what edges have, only the
    ends, the id and the asked type's number move: ident, made of src and tgt, spares the id too.
    """
    ident = F.col("edge_id") if ident is None else ident
    kept = [c for c in ("edge_id",) if c in edges.columns]
    rules = nodes.sparkSession.createDataFrame([(e, a, b) for e, _, a, b in S.EDGE_RULES], "asked string, a string, b string")
    label = lambda end, name: nodes.select(F.col("key").alias(end), F.col("label").alias(name))
    asks = sorted({e for e, *_ in S.EDGE_RULES})
    number = F.lit(None).cast("byte")
    for i, name in enumerate(asks):
        number = F.when(F.col("asked") == name, F.lit(i).cast("byte")).otherwise(number)
    # whether an edge that fits needs a judge is known from its types alone
    e = edges.select("src", "tgt", *kept, number.alias("ask"), (F.col("type").isin(*S.SYMMETRIC) & ~F.col("asked").isin(*S.SYMMETRIC)).alias("open"))
    j = e.join(label("src", "a"), "src", "left").join(label("tgt", "b"), "tgt", "left")
    j = j.withColumn("asked", F.get(F.array(*map(F.lit, asks)), F.col("ask").cast("int")))
    fits = F.broadcast(rules.withColumn("fits", F.lit(True)))
    turned = F.broadcast(rules.select("asked", F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("turned")))
    j = j.join(fits, ["asked", "a", "b"], "left").join(turned, ["asked", "a", "b"], "left")
    unsure = F.col("open") & (F.col("fits") | F.col("turned"))
    return j.select(ident.alias("edge_id"), F.when(unsure, "judge").when(F.col("fits"), "forward").when(F.col("turned"), "reverse").otherwise("keep").alias("verdict"))


def clear_after_retype(edges: DataFrame) -> DataFrame:
    """Edges whose type was changed lose the marks of the check of their former type."""
    gone = F.col("retyped_from").isNotNull()
    return edges.withColumns({c: F.when(~gone, F.col(c)) for c in ("stage1", "suspect")})


def head_and_variants(df: DataFrame, column: str) -> DataFrame:
    """A list that a merge made of a single value: its head again, the list kept beside it."""
    return df.withColumn(f"{column}_variants", F.col(column)).withColumn(column, F.get(F.col(column), 0))


def orphan_marks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, is_orphan, change) of nodes (key, is_orphan, is_seed): mark what no edge touches, unmark what one does; a seed would be an error."""
    ends = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("tgt").alias("key"))).distinct().withColumn("_met", F.lit(True))
    j = nodes.join(ends, "key", "left").withColumn("now", F.col("_met").isNull())
    change = F.when(F.col("now") & F.col("is_seed"), "refused").when(F.col("now") & ~F.col("is_orphan"), "mark").when(~F.col("now") & F.col("is_orphan"), "unmark")
    return j.select("key", (F.col("now") & ~F.col("is_seed")).alias("is_orphan"), change.alias("change"))


def split_rows(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What a purge removes, for its log, and what stays; a null condition stays."""
    hit = F.coalesce(condition, F.lit(False))
    return df.where(hit), df.where(~hit)


def audit_properties(edges: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edge_id, properties as JSON) of edges that carry audit marks, and the edges without these columns."""
    marked = edges.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())
    return marked.select("edge_id", F.to_json(F.struct(*columns)).alias("properties")), edges.drop(*columns)
