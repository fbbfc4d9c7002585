"""Articles and evidence: the gate of rules, upserts, what is still to do, and texts behind evidence ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from . import dictionary as D

#: Words of relations and of risks that let an article pass.
RELATION_WORDS = ("인수", "합병", "피인수", "매각", "양수", "양도", "인수합병", "M&A", "지분", "출자", "투자", "지주", "계열", "자회사", "최대주주", "주주", "공급", "납품", "수주", "계약", "체결", "발주", "조달", "위탁", "외주", "거래", "구매", "판매", "공급망", "밸류체인", "협력사", "파트너사", "제휴", "협력", "협약", "MOU", "합작", "JV", "공동개발", "공동", "기술이전", "라이선스", "동맹", "파트너십", "손잡", "맞손", "입점", "진출", "협업", "소송", "제소", "피소", "고소", "분쟁", "특허침해", "침해", "갈등", "규제", "제재", "과징금", "조사", "시정명령", "위반", "담합", "공정위", "경쟁", "점유율", "1위", "추격", "맞대결", "격차", "리콜", "결함", "화재", "사고", "중단", "차질", "부도", "회생", "구조조정")
RISK_WORDS = (
    "화재", "폭발", "정전", "누출", "붕괴", "가동중단", "생산차질", "공장중단", "셧다운", "리콜", "결함", "불량", "안전사고", "중대재해", "품질문제", "파업", "총파업", "노조", "노동쟁의", "임단협", "쟁의", "태업",
    "과징금", "제재", "압수수색", "기소", "고발", "담합", "공정위", "국세청", "세무조사", "검찰", "특허침해", "소송", "가처분", "행정처분", "영업정지", "경영권", "분쟁", "소액주주", "행동주의", "주주제안", "횡령", "배임",
    "어닝쇼크", "적자전환", "영업손실", "신용등급", "유동성", "감사의견", "상장폐지", "공급망", "수출규제", "관세", "수급차질", "병목", "재고조정", "감산",
    "불안", "위기", "우려", "타격", "차질", "이중고", "비상", "경고", "논란", "의혹", "제동", "무산", "철회", "결렬", "반발", "갈등", "적자", "부진", "급감", "위축", "축소", "중단", "지연", "연기", "사고", "누락", "실패", "취소", "해지", "탈락", "제외",
)
#: Columns of an article that a second sighting overwrites; all others stay as first seen.
OVERWRITTEN = ("rule_passed", "llm_relevant", "matched_corps", "body_length")


def any_word(c: Column, words) -> Column:
    return c.rlike("|".join(w.replace("&", "[&]") for w in words))


def rule_gate(articles: DataFrame, names: DataFrame, *, track: str = "relation") -> DataFrame:
    """(ident, passed, why, codes): articles (ident, title, body) that name a firm of names (code, name) and hold a word of the track.

    codes are those of all names that stand in the article, longest names first. Names of one letter are not looked for.
    """
    blob = F.concat_ws(" ", "title", F.coalesce("body", F.lit("")))
    rows = articles.select("ident", blob.alias("text")).withColumn("_h", F.xxhash64("text"))
    texts = rows.select(F.struct("ident", "_h").alias("ident"), "text").dropDuplicates(["ident"])
    found = D.occurrences(texts, names).select("ident", "code", "name", "len").distinct()
    codes = F.sort_array(F.collect_list(F.struct((-F.col("len")).alias("n"), "name", "code")))["code"]
    found = found.groupBy("ident").agg(codes.alias("codes")).select(F.col("ident.ident").alias("_i"), F.col("ident._h").alias("_g"), "codes")
    rows = rows.join(found, F.col("ident").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    relation, risk = any_word(F.col("text"), RELATION_WORDS), any_word(F.col("text"), RISK_WORDS)
    ok = {"relation": relation, "risk": risk, "both": relation | risk}[track]
    why = F.when(F.size("codes") == 0, "no_firm").when(~ok, "no_word").otherwise("passed")
    return rows.select("ident", (why == "passed").alias("passed"), why.alias("why"), "codes")


def upsert_articles(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new by url: of a known article only OVERWRITTEN changes, even to null."""
    n = new.withColumnsRenamed({c: f"_{c}" for c in new.columns if c != "url"}).withColumn("_there", F.lit(True))
    j = old.withColumn("_known", F.lit(True)).join(n, "url", "full_outer")
    pick = lambda c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) if c in OVERWRITTEN else F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_{c}"))
    return j.select("url", *[pick(c).alias(c) for c in old.columns if c != "url"])


def pending(articles: DataFrame, limit: int) -> DataFrame:
    """Articles that passed, were not extracted and not found irrelevant; newest first, those without a day last."""
    left = articles.where("rule_passed and extracted_at is null and coalesce(llm_relevant, true)")
    return left.orderBy(F.col("published_at").desc_nulls_last(), "url").limit(limit)


def leftovers(articles: DataFrame, names: DataFrame) -> DataFrame:
    """(url, names): articles found relevant but without an extraction, with the names of the firms they match."""
    left = articles.where("llm_relevant and extracted_at is null").select("url", F.explode("matched_corps").alias("code"))
    return left.join(names, "code").groupBy("url").agg(F.array_sort(F.collect_set("name")).alias("names"))


def titles_resolved(articles: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ident, url): the first candidate, by place, whose headline is the article's: equal in its first 12 characters, or one inside the other.

    candidates (ident, place, title, url) are the hits that a search gave for each article, so the join is by article
    and not between all titles. Articles without one are dropped.
    """
    a = articles.select("ident", T.title_key(F.col("title")).alias("_a"))
    c = candidates.select("ident", "place", "url", T.title_key(F.col("title")).alias("_c"))
    head = lambda x: F.substring(x, 1, 12)
    alike = (head("_a") == head("_c")) | F.contains("_a", "_c") | F.contains("_c", "_a")
    j = a.join(c, "ident").where((F.length("_a") > 0) & (F.length("_c") > 0) & alike)
    return j.groupBy("ident").agg(F.min_by("url", F.struct("place", "url")).alias("url"))


def names_in_title(articles: DataFrame) -> DataFrame:
    """Articles (…, title, names) whose title itself holds one of the names."""
    return articles.where(F.exists("names", lambda n: F.contains(F.col("title"), n)))


def upsert_evidence(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """(evidence_id, text): the longest text of each id, old or new; new ones only if a validated edge carries the id."""
    valid = edges.where("validated").select("evidence_id").distinct()
    every = old.select("evidence_id", "text").unionByName(new.join(valid, "evidence_id", "left_semi").select("evidence_id", "text"))
    return every.groupBy("evidence_id").agg(F.max_by("text", F.struct(F.length("text").alias("n"), F.col("text"))).alias("text"))


def evidence_for(wanted: DataFrame, texts: DataFrame, press: DataFrame, titles: DataFrame) -> DataFrame:
    """(pos, evidence_id, text, source_doc, source_type, press, published_at, missing) for wanted (pos, evidence_id).

    texts (evidence_id, text, rcept_no, occurred_at) may lack an id: it stays, marked missing. The first address in a
    text leads to press (url, press, published_at), the receipt number to titles (rcept_no, title); both go by equality.
    """
    url = F.nullif(F.regexp_replace(F.regexp_extract("text", r"https?://\S+", 0), "[)）」]+$", ""), F.lit(""))
    t = texts.withColumn("_there", F.lit(True)).withColumn("url", url).withColumn("rcept_no", F.nullif("rcept_no", F.lit("")))
    j = wanted.join(t, "evidence_id", "left")
    # most texts lack one or the other: these rows would all meet in the task of the null key
    for known, c in ((press, "url"), (titles, "rcept_no")):
        spread = F.coalesce(c, F.concat(F.lit(" "), "evidence_id"))
        j = j.withColumn("_at", spread).join(known.withColumnRenamed(c, "_known"), F.col(c).isNotNull() & (F.col("_at") == F.col("_known")), "left").drop("_at", "_known")
    day = F.when(F.col("occurred_at") > 19000000, F.to_date(F.col("occurred_at").cast("string"), "yyyyMMdd").cast("string"))
    there = F.coalesce("_there", F.lit(False))
    return j.select(
        "pos", "evidence_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("rcept_no", "url", F.lit("")).alias("source_doc"),
        F.when(F.col("rcept_no").isNotNull(), "dart").otherwise("news").alias("source_type"), F.coalesce("press", "title").alias("press"), F.coalesce("published_at", day).alias("published_at"), (~there).alias("missing"),
    )


def evidence_union(*sources: DataFrame) -> DataFrame:
    """(pos, evidence_id): ids of several lists (owner, ids), in order of lists, owners, places and ids, each at its first sight."""
    rows = None
    for k, df in enumerate(sources):
        part = df.select(F.lit(k).alias("list"), "owner", F.posexplode("ids").alias("at", "evidence_id"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.where("evidence_id is not null and evidence_id <> ''").groupBy("evidence_id").agg(F.min(F.struct("list", "owner", "at")).alias("first"))
    return first.select(F.row_number().over(W.orderBy("first", "evidence_id")).alias("pos"), "evidence_id")


def company_news(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """(company, url, title): the distinct articles behind a firm's news edges, at either end."""
    news = edges.where("source_type = 'news'")
    ends = news.select(F.col("src").alias("company"), F.col("source_doc").alias("url")).unionByName(news.select(F.col("tgt").alias("company"), F.col("source_doc").alias("url"))).distinct()
    return ends.join(articles.select("url", "title"), "url")


def ledger(runs: DataFrame) -> DataFrame:
    """(stage, runs, done, failed, last): what a ledger of runs (stage, item, status, ended) says of each stage, an item's last run counting."""
    last = runs.groupBy("stage", "item").agg(F.max_by("status", F.struct("ended", "status")).alias("status"), F.max("ended").alias("ended"), F.count("*").alias("n"))
    return last.groupBy("stage").agg(F.sum("n").alias("runs"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") != "done").alias("failed"), F.max("ended").alias("last"))
