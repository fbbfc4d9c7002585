"""Disclosures, articles, evidence, names and persons as rows of the relational tables, each query over all of them.

The tables hold no Korean text, so each projection makes it from their keys; the same expressions serve Spark and the SQL.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import answers, articles, people, reports, resolution
from ..sources import graph as G
from .rank_queries import shared_checkpoint
from .registry import query


class Rows(NamedTuple):
    table: str
    columns: tuple[str, ...]
    where: str = "true"

    def df(self, spark: SparkSession, d: str) -> DataFrame:
        return G.table(spark, d, self.table).where(self.where).selectExpr(*self.columns)

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self.columns)} FROM {self.table} WHERE {self.where})"


def q(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


SYLLABLES = Rows("part", ("p_partkey AS id", "substr('가각갂갃간갅갆갇갈갉갊갋갌갍갎갏감갑값갓갔강갖갗갘같갚갛', CAST(p_partkey % 28 + 1 AS INT), 1) || substr('나도류브사지하', CAST(p_partkey % 7 + 1 AS INT), 1) || 'Co' AS s"))
_CODE = "(unicode(s[i]) - 44032)"
_ROMAN = f"array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN unicode(s[i]) BETWEEN 44032 AND 55203 THEN {q(T.INITIALS)}[{_CODE} // 588 + 1] || {q(T.MEDIALS)}[({_CODE} % 588) // 28 + 1] || {q(T.FINALS)}[{_CODE} % 28 + 1] WHEN regexp_matches(s[i], '[\\pL\\pN]') THEN lower(s[i]) ELSE '' END), '')"


@query(f"SELECT id, {_ROMAN} AS roman FROM {SYLLABLES.sql}", with_graph=False)
def romanized_names(spark, d):
    return SYLLABLES.df(spark, d).select("id", T.romanize(F.col("s")).alias("roman"))


FOREIGN = Rows("customer", ("c_custkey AS id", "CASE c_custkey % 7 WHEN 0 THEN '브로드컴' WHEN 1 THEN 'Broadcom Inc' WHEN 2 THEN '마이크론 테크놀로지' WHEN 3 THEN 'Micron Technology' WHEN 4 THEN '램리서치' WHEN 5 THEN 'Lam Research' ELSE 'X' END AS t"))


def _skeleton_sql() -> str:
    cut = "CASE " + " ".join(f"WHEN ends_with(lower(t), '{e}') AND length(t) > {len(e) + 2} THEN left(t, length(t) - {len(e)})" for e in T.NAME_ENDINGS) + " ELSE t END"
    fold = "x"
    for a, b in T.FOLDED:
        fold = f"replace({fold}, '{a}', '{b}')"
    latin = f"CASE WHEN regexp_matches(s, '[가-힣]') THEN {_ROMAN} ELSE lower(s) END"
    plain = f"regexp_replace(replace(regexp_replace({latin}, '[^a-z0-9]', '', 'g'), 'eu', ''), 's$', '')"
    once = "array_to_string(list_transform(list_filter(range(1, length(y) + 1), lambda i: i = 1 OR y[i] <> y[i - 1]), lambda i: y[i]), '')"
    return f"SELECT id, regexp_replace({once}, '[aeiou]', '', 'g') AS skeleton FROM (SELECT id, {fold} AS y FROM (SELECT id, {plain} AS x FROM (SELECT id, {cut} AS s FROM {FOREIGN.sql})))"


@query(_skeleton_sql(), with_graph=False)
def name_skeletons(spark, d):
    return FOREIGN.df(spark, d).select("id", T.skeleton(F.col("t")).alias("skeleton"))


@query(f"WITH k AS ({_skeleton_sql()}) SELECT l.a, k.id AS b FROM k JOIN (SELECT skeleton, min(id) AS a FROM k WHERE length(skeleton) >= 3 GROUP BY skeleton) l USING (skeleton) WHERE k.id <> l.a", with_graph=False)
def foreign_pairs(spark, d):
    k = FOREIGN.df(spark, d).select("id", T.skeleton(F.col("t")).alias("skeleton")).where("length(skeleton) >= 3")
    return resolution.blocked_pairs(k, ["skeleton"], "id")


DATED = Rows("orders", ("o_orderkey AS id", "'계약 ' || CAST(year(o_orderdate) AS STRING) || '년 ' || CAST(month(o_orderdate) AS STRING) || '월 ' || CAST(day(o_orderdate) AS STRING) || '일, 공시 2026.3.' || CAST(o_orderkey % 28 + 1 AS STRING) || ' 및 2025년 ' || CAST(o_orderkey % 12 + 1 AS STRING) || '월' AS t"))


@query(r"SELECT id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일', '\1-#0\2-#0\3', 'g'), '\b(\d{4})[./](\d{1,2})[./](\d{1,2})\b', '\1-#0\2-#0\3', 'g'), '(\d{4})\s*년\s*(\d{1,2})\s*월', '\1-#0\2', 'g'), '#0(\d\d)', '\1', 'g'), '#', '') AS t FROM " + DATED.sql, with_graph=False)
def iso_dates(spark, d):
    return DATED.df(spark, d).select("id", T.dates_to_iso(F.col("t")).alias("t"))


STATEMENTS = Rows("customer", ("c_custkey AS id", "c_acctbal AS net", "(c_custkey % 7 - 1) * 700 AS equity", "c_custkey % 5 * 900 AS assets"))
# In whole cents, halves away from zero: a quotient of doubles would round some halves down.
_cents = lambda a: f"CAST(round(CAST({a} AS DOUBLE) * 100) AS BIGINT)"
_pct = lambda a, b: f"CASE WHEN {b} <> 0 THEN sign({_cents(a)}) * sign({b}) * ((200 * abs({_cents(a)}) + abs({b})) // (2 * abs({b}))) / 100.0 + 0.0 END"


@query(f"SELECT id, {_pct('net', 'equity')} AS roe, {_pct('net', 'assets')} AS roa, {_pct('assets', 'equity')} AS debt_ratio FROM {STATEMENTS.sql}", with_graph=False)
def financial_ratios(spark, d):
    c = F.col
    return STATEMENTS.df(spark, d).select("id", V.percent_of(c("net"), c("equity")).alias("roe"), V.percent_of(c("net"), c("assets")).alias("roa"), V.percent_of(c("assets"), c("equity")).alias("debt_ratio"))


QUESTIONS = Rows("orders", ("o_orderkey AS id", "CASE o_orderkey % 9 WHEN 0 THEN '삼성에 납품하는 기업' WHEN 1 THEN '삼성이 납품하는 곳' WHEN 2 THEN '누가 투자했나' WHEN 3 THEN '소송과 규제' WHEN 4 THEN '협력과 경쟁' WHEN 5 THEN '삼성을 제소한 곳' WHEN 6 THEN '삼성이 출자하고 하이닉스에 출자한 곳' WHEN 7 THEN '공급이 줄고 삼성이 제소' ELSE '임원' END AS t"))


def _intent_sql() -> str:
    deep = [f"CASE WHEN regexp_matches(t, '{w}') THEN '{k}' END" for k, w, _, _ in answers.ASKED]
    plain = [f"CASE WHEN contains(t, '{w}') THEN '{k}' END" for k, w in answers.ASKED_BY_WORD]
    way = ", ".join(f"CASE WHEN regexp_matches(t, '{w}') THEN CASE WHEN regexp_matches(t, '{o}') AND NOT regexp_matches(t, '{i}') THEN 'outgoing' WHEN regexp_matches(t, '{i}') AND NOT regexp_matches(t, '{o}') THEN 'incoming' END END" for _, w, o, i in answers.ASKED)
    return f"SELECT id, array_to_string(list_filter([{', '.join(deep + plain)}], lambda x: x IS NOT NULL), ',') AS types, coalesce({way}) AS direction FROM {QUESTIONS.sql}"


@query(_intent_sql(), with_graph=False)
def relation_intents(spark, d):
    types, direction = answers.asked_relations(F.col("t"))
    return QUESTIONS.df(spark, d).select("id", F.array_join(types, ",").alias("types"), direction.alias("direction"))


_claim = "replace(replace(CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.CLAIMS.items()) + " ELSE '{a}과(와) {b}이(가) ' || type || ' 관계다' END, '{a}', src), '{b}', tgt) || '.'"


@query(f"SELECT src, tgt, type, {_claim} AS claim FROM (SELECT src, tgt, CASE WHEN type = 'DEVELOPS' AND src = 'S1' THEN 'KNOWS' ELSE type END AS type FROM simple_edges)")
def claim_sentences(spark, d):
    kind = F.when((F.col("type") == "DEVELOPS") & (F.col("src") == "S1"), "KNOWS").otherwise(F.col("type"))
    return G.simple_edges(spark, d).withColumn("type", kind).select("src", "tgt", "type", reports.claim_sentence(F.col("type"), F.col("src"), F.col("tgt")).alias("claim"))


GROUPS = Rows("customer", ("c_custkey AS id", "CASE c_custkey % 6 WHEN 0 THEN 'SK그룹' WHEN 1 THEN '현대차그룹' WHEN 2 THEN '롯데 그룹' WHEN 3 THEN '한화일가' WHEN 4 THEN '그룹' ELSE '카카오' END AS t"))


@query(f"SELECT id, CASE base WHEN '' THEN NULL {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in T.GROUP_FIRMS.items())} ELSE base END AS firm FROM (SELECT id, regexp_extract(t, '^(.+?)\\s*(?:그룹|계열|일가)$', 1) AS base FROM {GROUPS.sql})", with_graph=False)
def group_aliases(spark, d):
    return GROUPS.df(spark, d).select("id", T.group_firm(F.col("t")).alias("firm"))


SHARES = Rows("lineitem", ("l_orderkey AS id", "l_linenumber AS n", "CASE l_linenumber % 3 WHEN 0 THEN CAST(l_discount AS DOUBLE) WHEN 1 THEN l_discount * 100.0 ELSE 0.5 END AS v", "'지분 ' || CAST(CAST(round(l_discount * 100) AS INT) AS STRING) || ' %를 취득' AS t"))


@query(rf"SELECT id, n, CASE WHEN len(list_filter(p, lambda x: abs(x - v) < 0.01)) > 0 THEN v WHEN len(list_filter(p, lambda x: abs(x - v * 100) < 0.01)) > 0 THEN round(v * 100, 4) ELSE v END AS ratio FROM (SELECT id, n, v, list_transform(regexp_extract_all(t, '([0-9]+(?:\.[0-9]+)?)\s*%', 1), lambda x: CAST(x AS DOUBLE)) AS p FROM {SHARES.sql})", with_graph=False)
def ratio_units(spark, d):
    return SHARES.df(spark, d).select("id", "n", V.ratio_in_percent(F.col("v").cast("double"), F.col("t")).alias("ratio"))


STAKES = Rows("lineitem", ("l_orderkey AS id", "l_linenumber AS n", "l_quantity * 3 - 20 AS ratio", "CASE WHEN l_linenumber > 1 THEN l_tax * 2000 END AS previous_ratio", "l_quantity - 3 AS share_count", "CASE l_linenumber % 3 WHEN 0 THEN '2024-12-31' WHEN 1 THEN '2024.12.31' END AS settlement_date"))


@query(f"SELECT id, n, concat_ws(',', CASE WHEN ratio NOT BETWEEN 0 AND 100 THEN 'ratio' END, CASE WHEN previous_ratio NOT BETWEEN 0 AND 100 THEN 'previous_ratio' END, CASE WHEN share_count < 0 THEN 'share_count' END, CASE WHEN settlement_date LIKE '%.%' THEN 'settlement_date' END) AS faults FROM {STAKES.sql}", with_graph=False)
def stake_faults(spark, d):
    return reports.stake_faults(STAKES.df(spark, d)).select("id", "n", F.array_join("faults", ",").alias("faults"))


POSTS = Rows("orders", ("o_orderkey AS id", "CAST(o_orderkey % 1500 - 100 AS INT) AS tenure_months", "CASE o_orderkey % 5 WHEN 0 THEN '1960-05' WHEN 1 THEN '1899-01' WHEN 2 THEN '2099-01' WHEN 3 THEN '미상' END AS birth", "CASE o_orderkey % 3 WHEN 0 THEN '2024-12-31' WHEN 1 THEN '2024' END AS settlement_date"))


@query(f"SELECT id, concat_ws(',', CASE WHEN tenure_months NOT BETWEEN 0 AND 1200 THEN 'tenure_months' END, CASE WHEN settlement_date = '2024' THEN 'settlement_date' END) AS faults, birth IS NOT NULL AND birth <> '1960-05' AS birth_odd FROM {POSTS.sql}", with_graph=False)
def post_faults(spark, d):
    return reports.post_faults(POSTS.df(spark, d), "2024-06-30").select("id", F.array_join("faults", ",").alias("faults"), "birth_odd")


NEWS = Rows("orders", ("o_orderkey AS ident", "CASE o_orderkey % 6 WHEN 0 THEN '삼성전자 반도체 공급 계약' WHEN 1 THEN 'SK하이닉스 공장 화재' WHEN 2 THEN '삼성전자와 SK하이닉스 경쟁' WHEN 3 THEN '화재 소식' WHEN 4 THEN '네이버 실적 발표' ELSE '네이버 파업 우려' END AS title", "CASE WHEN o_orderkey % 5 = 0 THEN '카카오와 협력' END AS body"))
_FIRMS = [(1, "삼성전자"), (2, "SK하이닉스"), (3, "네이버"), (4, "카카오")]
_alt = lambda words: "|".join(w.replace("&", "[&]") for w in words)


def _gate_sql(track: str) -> str:
    codes = ", ".join(f"CASE WHEN contains(blob, '{n}') THEN '{c}' END" for c, n in sorted(_FIRMS, key=lambda f: (-len(f[1]), f[1])))
    word = {"relation": f"regexp_matches(blob, '{_alt(articles.RELATION_WORDS)}')", "risk": f"regexp_matches(blob, '{_alt(articles.RISK_WORDS)}')"}[track]
    return f"SELECT ident, why = 'passed' AS passed, why, codes FROM (SELECT ident, codes, CASE WHEN codes = '' THEN 'no_firm' WHEN NOT {word} THEN 'no_word' ELSE 'passed' END AS why FROM (SELECT ident, blob, concat_ws(',', {codes}) AS codes FROM (SELECT ident, title || ' ' || coalesce(body, '') AS blob FROM {NEWS.sql})))"


def _gate(spark, d, track):
    names = spark.createDataFrame(_FIRMS, "code int, name string")
    return articles.rule_gate(NEWS.df(spark, d), names, track=track).withColumn("codes", F.array_join(F.transform("codes", lambda c: c.cast("string")), ","))


@query(_gate_sql("relation"), with_graph=False)
def gate_relation(spark, d):
    return _gate(spark, d, "relation")


@query(_gate_sql("risk"), with_graph=False)
def gate_risk(spark, d):
    return _gate(spark, d, "risk")


_article = ("'u' || CAST(event_id AS STRING) AS url", "event_type AS title", "event_id % 4 <> 1 AS rule_passed", "CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN true END AS llm_relevant", "CAST(user_id AS STRING) AS matched_corps", "CAST(event_id % 100 AS INT) AS body_length")
OLD_ARTICLES = Rows("events", _article, "event_id % 3 <> 0")
NEW_ARTICLES = Rows("events", ("'u' || CAST(event_id AS STRING) AS url", "'again' AS title", "event_id % 4 = 1 AS rule_passed", "CASE event_id % 7 WHEN 0 THEN true END AS llm_relevant", "'none' AS matched_corps", "7 AS body_length"), "event_id % 2 = 0")


@query(f"SELECT coalesce(o.url, n.url) AS url, CASE WHEN o.url IS NULL THEN n.title ELSE o.title END AS title, {', '.join(f'CASE WHEN n.url IS NULL THEN o.{c} ELSE n.{c} END AS {c}' for c in articles.OVERWRITTEN)} FROM {OLD_ARTICLES.sql} o FULL JOIN {NEW_ARTICLES.sql} n ON o.url = n.url", with_graph=False)
def article_upsert(spark, d):
    return articles.upsert_articles(OLD_ARTICLES.df(spark, d), NEW_ARTICLES.df(spark, d))


BACKLOG = Rows("events", ("'u' || CAST(event_id AS STRING) AS url", "event_id % 4 <> 1 AS rule_passed", "CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN true END AS llm_relevant", "CASE WHEN event_id % 3 = 0 THEN 'x' END AS extracted_at", "CASE WHEN event_id % 11 <> 0 THEN ts END AS published_at"))


@query(f"SELECT url FROM {BACKLOG.sql} WHERE rule_passed AND extracted_at IS NULL AND coalesce(llm_relevant, true) ORDER BY published_at DESC NULLS LAST, url LIMIT 300", with_graph=False)
def pending_articles(spark, d):
    return articles.pending(BACKLOG.df(spark, d), 300).select("url")


HEADLINES = Rows("part", ("p_partkey AS ident", "'[속보] ' || p_name || ' 가격 인상' AS title"))
HITS = [Rows("part", ("p_partkey AS ident", "0 AS place", "'<b>다른 기사</b>' AS title", "'u0/' || CAST(p_partkey AS STRING) AS url")), Rows("part", ("p_partkey AS ident", "1 AS place", "p_name || ' &quot;가격&quot; 인상, 왜' AS title", "'u1/' || CAST(p_partkey AS STRING) AS url"), "p_partkey % 2 = 0"), Rows("part", ("p_partkey AS ident", "2 AS place", "'가격 인상' AS title", "'u2/' || CAST(p_partkey AS STRING) AS url"), "p_partkey % 3 = 0")]
_tkey = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '&quot;', chr(34)), '^(\s*[\[〈<【][^\]〉>】]{{1,20}}[\]〉>】]\s*)+', ''), '[\"''‘’“”·ㆍ]', '', 'g'), '\s+', '', 'g')"


@query(f"WITH a AS (SELECT ident, {_tkey('title')} AS t FROM {HEADLINES.sql}), c AS (SELECT ident, place, url, {_tkey('title')} AS t FROM ({' UNION ALL '.join(f'SELECT * FROM {h.sql}' for h in HITS)})) SELECT a.ident, arg_min(c.url, c.place) AS url FROM a JOIN c ON a.ident = c.ident WHERE left(a.t, 12) = left(c.t, 12) OR contains(a.t, c.t) OR contains(c.t, a.t) GROUP BY a.ident", with_graph=False)
def title_resolution(spark, d):
    hits = HITS[0].df(spark, d).unionByName(HITS[1].df(spark, d)).unionByName(HITS[2].df(spark, d))
    return articles.titles_resolved(HEADLINES.df(spark, d), hits)


EVIDENCE_OLD = Rows("orders", ("'e' || CAST(o_orderkey % 300 AS STRING) AS evidence_id", "repeat('x', CAST(o_orderkey % 9 + 1 AS INT)) AS text"), "o_orderkey % 2 = 0")
EVIDENCE_NEW = Rows("orders", ("'e' || CAST(o_orderkey % 400 AS STRING) AS evidence_id", "repeat('y', CAST(o_orderkey % 13 + 1 AS INT)) AS text"))
VALID_EDGES = Rows("orders", ("'e' || CAST(o_orderkey % 400 AS STRING) AS evidence_id", "o_orderkey % 400 >= 150 AS validated"))


@query(f"SELECT evidence_id, arg_max(text, struct_pack(n := length(text), t := text)) AS text FROM (SELECT * FROM {EVIDENCE_OLD.sql} UNION ALL SELECT * FROM {EVIDENCE_NEW.sql} WHERE evidence_id IN (SELECT evidence_id FROM {VALID_EDGES.sql} WHERE validated)) GROUP BY evidence_id", with_graph=False)
def evidence_upsert(spark, d):
    return articles.upsert_evidence(EVIDENCE_OLD.df(spark, d), EVIDENCE_NEW.df(spark, d), VALID_EDGES.df(spark, d))


WANTED = Rows("orders", ("o_orderkey AS pos", "'e' || CAST(o_orderkey AS STRING) AS evidence_id"))
TEXTS = Rows("orders", ("'e' || CAST(o_orderkey AS STRING) AS evidence_id", "CASE o_orderkey % 3 WHEN 0 THEN '본문 https://news.example/' || CAST(o_orderkey AS STRING) || ')' ELSE '본문' END AS text", "CASE o_orderkey % 4 WHEN 1 THEN 'r' || CAST(o_orderkey AS STRING) ELSE '' END AS rcept_no", "CASE WHEN o_orderkey % 2 = 0 THEN 20240105 ELSE 0 END AS occurred_at"), "o_orderkey % 5 <> 0")
PRESS = Rows("orders", ("'https://news.example/' || CAST(o_orderkey AS STRING) AS url", "'Daily' AS press", "'2024-02-02' AS published_at"), "o_orderkey % 6 = 0")
TITLES = Rows("orders", ("'r' || CAST(o_orderkey AS STRING) AS rcept_no", "'공시 ' || CAST(o_orderkey AS STRING) AS title"), "o_orderkey % 8 = 1")


@query(rf"WITH t AS (SELECT *, nullif(regexp_replace(regexp_extract(text, 'https?://\S+'), '[)）」]+$', ''), '') AS url, nullif(rcept_no, '') AS rn FROM {TEXTS.sql}) SELECT w.pos, w.evidence_id, coalesce(t.text, '') AS text, coalesce(t.rn, t.url, '') AS source_doc, CASE WHEN t.rn IS NOT NULL THEN 'dart' ELSE 'news' END AS source_type, coalesce(p.press, x.title) AS press, coalesce(p.published_at, CASE WHEN t.occurred_at > 0 THEN '2024-01-05' END) AS published_at, t.evidence_id IS NULL AS missing FROM {WANTED.sql} w LEFT JOIN t ON w.evidence_id = t.evidence_id LEFT JOIN {PRESS.sql} p ON t.url = p.url LEFT JOIN {TITLES.sql} x ON t.rn = x.rcept_no", with_graph=False)
def evidence_resolution(spark, d):
    return articles.evidence_for(WANTED.df(spark, d), TEXTS.df(spark, d), PRESS.df(spark, d), TITLES.df(spark, d))


ORDER_NEWS = Rows("orders", ("'order-' || CAST(o_orderkey AS STRING) AS url", "o_orderstatus AS title"), "o_orderkey % 3 <> 0")


@query(f"SELECT DISTINCT company, url, title FROM (SELECT src AS company, source_doc AS url FROM supplies WHERE source_type = 'news' UNION SELECT tgt, source_doc FROM supplies WHERE source_type = 'news') JOIN {ORDER_NEWS.sql} USING (url)")
def company_news(spark, d):
    return articles.company_news(G.supplies(spark, d), ORDER_NEWS.df(spark, d))


RUNS = Rows("events", ("event_type AS stage", "user_id % 50 AS item", "CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status", "event_id AS ended"))


@query(f"SELECT stage, CAST(sum(n) AS BIGINT) AS runs, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status <> 'done') AS failed, max(ended) AS last FROM (SELECT stage, item, arg_max(status, ended) AS status, max(ended) AS ended, count(*) AS n FROM {RUNS.sql} GROUP BY ALL) GROUP BY stage", with_graph=False)
def run_ledger(spark, d):
    return articles.ledger(RUNS.df(spark, d))


FILINGS = Rows("orders", ("o_custkey AS corp", "o_orderkey AS rcept_no", "CASE o_orderkey % 8 WHEN 0 THEN '사업보고서 (2023.12)' WHEN 1 THEN '[첨부정정]사업보고서' WHEN 2 THEN '반기보고서' WHEN 3 THEN '단일판매ㆍ공급계약체결' WHEN 4 THEN '단일판매ㆍ공급계약해지' WHEN 5 THEN '사업보고서(해외증권거래소신고)' WHEN 6 THEN '[기재정정]단일판매ㆍ공급계약체결' ELSE '분기보고서' END AS title", "o_orderdate AS filed"))


@query(f"SELECT corp, arg_max(rcept_no, struct_pack(w := NOT contains(title, '[첨부'), f := filed, r := rcept_no)) AS rcept_no FROM {FILINGS.sql} WHERE contains(title, '사업보고서') AND NOT contains(title, '해외') GROUP BY corp", with_graph=False)
def annual_reports(spark, d):
    return reports.annual_reports(FILINGS.df(spark, d))


@query(f"SELECT corp, rcept_no FROM {FILINGS.sql} WHERE contains(title, '공급계약체결')", with_graph=False)
def supply_filings(spark, d):
    return reports.supply_filings(FILINGS.df(spark, d)).select("corp", "rcept_no")


TAKEOVERS = Rows("orders", ("'c' || CAST(o_custkey AS STRING) AS corp", "CASE o_orderkey % 3 WHEN 0 THEN 'merger' WHEN 1 THEN 'shares' ELSE 'other' END AS kind", "CASE o_orderkey % 5 WHEN 0 THEN '주식회사 T' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'T' || CAST(o_orderkey AS STRING) || ' (구 이름)' WHEN 2 THEN '-' WHEN 3 THEN 'C' || CAST(o_custkey AS STRING) ELSE 'T ' || CAST(o_orderkey AS STRING) END AS target", "CAST(year(o_orderdate) AS STRING) || '년 3월 5일' AS decided", "CASE WHEN o_orderkey % 2 = 0 THEN '12.5' ELSE '-' END AS rate"))


@query(f"SELECT corp AS src, tgt, 'ACQUIRES' AS type, CASE kind WHEN 'merger' THEN '합병' ELSE '주식취득' END AS subtype, left(decided, 4) || '-03-05' AS occurred_at, CASE WHEN kind = 'shares' AND rate <> '-' THEN 12.5 END AS rate FROM (SELECT *, lower(regexp_replace(regexp_replace(target, '주식회사|\\(.*\\)', '', 'g'), '\\s', '', 'g')) AS tgt FROM {TAKEOVERS.sql} WHERE target <> '-') WHERE kind <> 'other' AND tgt <> corp", with_graph=False)
def acquisitions(spark, d):
    return reports.acquisitions(TAKEOVERS.df(spark, d))


SUITS = Rows("orders", ("'c' || CAST(o_custkey AS STRING) AS corp", "CAST(o_orderkey AS STRING) AS rcept_no", "CASE WHEN o_orderkey % 2 = 0 THEN '손해배상' ELSE '-' END AS case_name", "CASE o_orderkey % 4 WHEN 0 THEN '원고' || CAST(o_orderkey % 20 AS STRING) WHEN 1 THEN '개인 OO' WHEN 2 THEN '-' ELSE '미상' || CAST(o_orderkey AS STRING) END AS opponent", "CAST(year(o_orderdate) AS STRING) || '년 3월 5일' AS filed"))
PLAINTIFFS = Rows("supplier", ("'S' || CAST(s_suppkey AS STRING) AS key", "'원고' || CAST(s_suppkey % 12 AS STRING) AS name"))


@query(f"WITH f AS (SELECT name, min(key) AS opp FROM {PLAINTIFFS.sql} GROUP BY name HAVING count(DISTINCT key) = 1) SELECT coalesce(opp, corp) AS src, CASE WHEN opp IS NULL THEN 'evt_' || rcept_no ELSE corp END AS tgt, CASE WHEN opp IS NULL THEN 'HAS_EVENT' ELSE 'SUES' END AS type, CASE WHEN opp IS NULL OR case_name = '-' THEN '소송' ELSE case_name END AS subtype, left(filed, 4) || '-03-05' AS occurred_at FROM {SUITS.sql} LEFT JOIN f ON opponent = f.name", with_graph=False)
def lawsuits(spark, d):
    return reports.lawsuits(SUITS.df(spark, d), PLAINTIFFS.df(spark, d))


PRODUCTS = Rows("part", ("'S' || CAST(p_partkey % 10 AS STRING) AS corp", "CASE p_partkey % 9 WHEN 0 THEN ' A ' ELSE p_name END AS name", "CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS category"))


@query(f"SELECT DISTINCT corp AS src, lower(replace(name, ' ', '')) AS tgt, coalesce(category, '제품') AS subtype FROM {PRODUCTS.sql} WHERE length(replace(name, ' ', '')) >= 2", with_graph=False)
def product_edges(spark, d):
    return reports.product_edges(PRODUCTS.df(spark, d))


CONTRACTS = Rows("orders", ("'c' || CAST(o_custkey % 50 AS STRING) AS corp", "CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'C' || CAST(o_orderkey % 50 AS STRING) END AS counterparty", "CASE o_orderkey % 4 WHEN 0 THEN 'PARTNERS_WITH' WHEN 1 THEN 'DEPENDS_ON' WHEN 2 THEN 'KNOWS' ELSE 'SUPPLIES_TO' END AS edge_type", "CASE o_orderkey % 3 WHEN 0 THEN 'they_supply' WHEN 1 THEN 'we_supply' END AS direction", "o_orderstatus AS subtype"))


@query(f"SELECT CASE WHEN turned THEN o ELSE corp END AS src, CASE WHEN turned THEN corp ELSE o END AS tgt, edge_type AS type, subtype FROM (SELECT *, coalesce((edge_type = 'SUPPLIES_TO' AND direction = 'they_supply') OR (edge_type = 'PARTNERS_WITH' AND corp > o), false) AS turned FROM (SELECT *, lower(counterparty) AS o FROM {CONTRACTS.sql} WHERE trim(counterparty) <> '' AND edge_type <> 'KNOWS')) WHERE edge_type = 'DEPENDS_ON' OR o <> corp", with_graph=False)
def contract_relations(spark, d):
    return reports.contract_edges(CONTRACTS.df(spark, d))


SENTENCES = Rows("customer", ("c_custkey AS id", "CASE c_custkey % 3 WHEN 0 THEN '김철수' WHEN 1 THEN '삼성물산' ELSE 'ABC' END AS src", "c_name AS tgt", "CASE WHEN c_custkey % 2 = 0 THEN '최대주주' END AS subtype", "CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 5 AS INT) END AS ratio", "CAST(c_custkey % 4 AS INT) AS previous", "CASE WHEN c_custkey % 7 > 0 THEN '2024-12-31' END AS day"))


@query(f"SELECT id, concat_ws(' ', src || CASE WHEN src = '삼성물산' THEN '은 ' ELSE '는 ' END || tgt || '의 ' || coalesce(subtype, '지분') || '로 지분 ' || coalesce(ratio || '%', '비공개') || '를 보유하고 있다.', CASE WHEN previous <> ratio THEN '직전 지분율 ' || previous || '%에서 변동되었다.' END, '기준일 ' || day || '.') AS sentence FROM {SENTENCES.sql}", with_graph=False)
def stake_sentences(spark, d):
    c = F.col
    return SENTENCES.df(spark, d).select("id", reports.stake_sentence(c("src"), c("tgt"), c("subtype"), c("ratio"), c("previous"), c("day")).alias("sentence"))


FIRMS = Rows("customer", ("c_custkey AS key", "CASE WHEN c_custkey % 3 = 0 THEN 'k' || CAST(c_custkey AS STRING) END AS corp_code", "'회사' || CAST(c_custkey % 200 AS STRING) AS name", "CASE WHEN c_custkey % 5 = 0 THEN '26' END AS induty"))
REGISTRY = Rows("customer", ("'k' || CAST(c_custkey AS STRING) AS corp_code", "'주식회사 회사' || CAST(c_custkey % 170 AS STRING) AS name", "c_mktsegment AS induty"), "c_custkey % 2 = 0")


@query(f"WITH r AS (SELECT *, replace(name, '주식회사 ', '') AS k FROM {REGISTRY.sql}), n AS (SELECT k, min(corp_code) AS c2, min(induty) AS i2 FROM r GROUP BY k HAVING count(DISTINCT corp_code) = 1) SELECT f.key, coalesce(f.corp_code, n.c2) AS corp_code, f.name, coalesce(f.induty, r.induty, n.i2) AS induty FROM {FIRMS.sql} f LEFT JOIN r ON f.corp_code = r.corp_code LEFT JOIN n ON f.name = n.k", with_graph=False)
def registry_fill(spark, d):
    return reports.registry_fill(FIRMS.df(spark, d), REGISTRY.df(spark, d))


OWNED = Rows("orders", ("o_custkey AS src", "o_orderkey % 997 AS tgt", "CASE WHEN o_orderkey % 3 = 0 THEN 'bulk' ELSE 'main' END AS holder_kind", "o_orderkey % 4 AS ratio"))
FIGURES = Rows("customer", ("c_custkey AS tgt", "c_acctbal AS total_assets"))


@query(f"SELECT min(src) AS src, tgt, any_value(total_assets) AS total_assets FROM {OWNED.sql} JOIN {FIGURES.sql} USING (tgt) GROUP BY tgt HAVING count(*) = 1", with_graph=False)
def investee_figures(spark, d):
    return reports.investee_figures(OWNED.df(spark, d), FIGURES.df(spark, d))


@query(f"SELECT tgt, CAST(sum(ratio) AS DOUBLE) AS total FROM {OWNED.sql} WHERE holder_kind = 'bulk' GROUP BY tgt HAVING sum(ratio) < 5", with_graph=False)
def five_percent_faults(spark, d):
    return reports.five_percent_faults(OWNED.df(spark, d))


NAMED = Rows("part", ("p_partkey AS key", "CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '-') END AS name", "p_partkey % 10 AS degree"))


@query(f"WITH p AS (SELECT *, lower(regexp_replace(name, '[ -]', '', 'g')) AS k FROM {NAMED.sql}), g AS (SELECT k, arg_min(key, struct_pack(d := -degree, key := key)) AS keep FROM p GROUP BY k HAVING count(*) > 1) SELECT key AS old, keep FROM p JOIN g USING (k) WHERE key <> keep", with_graph=False)
def product_keepers(spark, d):
    return reports.product_keepers(NAMED.df(spark, d))


@query("SELECT src || tgt AS edge_id, CASE WHEN asked = 'PARTNERS_WITH' THEN 'keep' WHEN type = 'DEVELOPS' THEN 'forward' WHEN type = 'DEPENDS_ON' THEN 'judge' ELSE 'reverse' END AS verdict FROM (SELECT CASE WHEN type = 'REGULATES' THEN tgt ELSE src END AS src, CASE WHEN type = 'REGULATES' THEN src ELSE tgt END AS tgt, type, CASE WHEN type = 'REGULATES' THEN 'REGULATES' WHEN src LIKE '%7' THEN 'PARTNERS_WITH' ELSE 'DEPENDS_ON' END AS asked FROM simple_edges)")
def type_verdicts(spark, d):
    e = G.simple_edges(spark, d)
    back = F.col("type") == "REGULATES"
    e = e.withColumn("asked", F.when(back, "REGULATES").when(F.col("src").endswith("7"), "PARTNERS_WITH").otherwise("DEPENDS_ON"))
    e = e.select(F.when(back, F.col("tgt")).otherwise(F.col("src")).alias("src"), F.when(back, F.col("src")).otherwise(F.col("tgt")).alias("tgt"), F.when(F.col("type") == "DEPENDS_ON", "PARTNERS_WITH").otherwise(F.col("type")).alias("type"), "asked")
    return reports.type_verdicts(e, G.nodes(spark, d), F.concat("src", "tgt"))


@query("SELECT key, NOT met AND NOT seed AS is_orphan, CASE WHEN NOT met AND seed THEN 'refused' WHEN NOT met AND NOT marked THEN 'mark' WHEN met AND marked THEN 'unmark' END AS change FROM (SELECT key, key IN (SELECT src FROM supplies UNION SELECT tgt FROM supplies) AS met, key LIKE '%5' AS seed, key LIKE '%3' AS marked FROM nodes)")
def orphan_marks(spark, d):
    n = G.nodes(spark, d).select("key", F.col("key").endswith("3").alias("is_orphan"), F.col("key").endswith("5").alias("is_seed"))
    return reports.orphan_marks(n, G.supplies(spark, d))


BIRTHS = Rows("customer", ("'이름' || CAST(c_custkey % 120 AS STRING) AS name", "CASE WHEN c_custkey % 4 > 0 THEN CAST(1950 + c_custkey % 120 + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS STRING) || '-05' END AS birth"))


@query(f"SELECT name, min(birth) AS birth FROM {BIRTHS.sql} WHERE birth IS NOT NULL GROUP BY name HAVING count(DISTINCT birth) = 1", with_graph=False)
def births_by_name(spark, d):
    return people.births_by_name(BIRTHS.df(spark, d))


PERSONS = Rows("orders", ("o_custkey AS doc", "o_orderkey AS pos", "'n' || CAST(o_orderkey % 3 AS STRING) AS name", "CASE WHEN o_orderkey % 4 = 0 THEN 'n' || CAST(o_orderkey % 3 AS STRING) || '|19' || CAST(50 + o_orderkey % 40 AS STRING) ELSE 'n' || CAST(o_orderkey % 3 AS STRING) || '@' || CAST(o_orderkey AS STRING) END AS key"))


@query(f"SELECT p.doc, p.key, coalesce(c.canonical, p.key) AS canonical FROM {PERSONS.sql} p LEFT JOIN (SELECT doc, name, arg_min(key, pos) AS canonical FROM {PERSONS.sql} WHERE contains(key, '|') GROUP BY ALL) c ON p.doc = c.doc AND p.name = c.name", with_graph=False)
def person_keys(spark, d):
    return people.document_keys(PERSONS.df(spark, d))
