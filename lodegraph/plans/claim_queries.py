"""Claims checked against their evidence, over all events; the SQL writes out every fixed word by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims
from .record_queries import Rows
from .registry import query

CLAIMS = Rows(
    "events",
    (
        "CAST(event_id AS STRING) AS claim_id", "user_id % 25 AS answer_id", "user_id AS e1", "user_id + 1 AS e2", "event_id % 7 AS cites",
        "CASE event_id % 11 WHEN 0 THEN '한빛전자는 2024년 3월 18일에 두리상사에 부품을 납품했다' WHEN 1 THEN '두리상사 공장 화재로 인해 한빛전자 생산에 차질이 생겼다' WHEN 2 THEN '세움중공업의 대형 수주가 확대되었다' WHEN 3 THEN '노조 파업 때문에 2025.4.2 출하가 지연됐다' WHEN 4 THEN '한빛전자가 Gamma-X 라인에 투자한다' WHEN 5 THEN '관련 발표가 있다' WHEN 6 THEN '결함 여파로 리콜 비용이 두리상사 실적에 영향을 미쳤다' WHEN 7 THEN '한 빛' WHEN 8 THEN '' WHEN 9 THEN '규제를 위해 ' ELSE '정전으로 인해 라인이 중단됐고 세움중공업에서 2024년 3월 감산을 결정했다' END AS text",
    ),
)
SOURCES = Rows(
    "customer",
    (
        "CAST(c_custkey AS STRING) AS evidence_id", "c_custkey % 13 = 0 AS missing", "CASE WHEN c_custkey % 3 = 0 THEN '2024-03-18' WHEN c_custkey % 3 = 1 THEN '' END AS published_at",
        "CASE c_custkey % 5 WHEN 0 THEN '사고|기타' WHEN 1 THEN '기타' WHEN 2 THEN '파업' WHEN 3 THEN '사고|파업' END AS types",
        "CASE c_custkey % 9 WHEN 0 THEN '두리상사에 부품 납품. 한빛전자 계약 체결' WHEN 1 THEN '공장 화재로 생산 차질! 라인 중단' || chr(10) || chr(10) || '— 「한빛전자 타격」 http://a.b/c' WHEN 2 THEN '세움중공업 수주 확대' WHEN 3 THEN '노조가 파업해 2025년 4월 2일 출하를 멈췄다' WHEN 4 THEN '  ' WHEN 5 THEN 'gamma-x 투자 확정' WHEN 6 THEN '리콜 비용 실적 반영' WHEN 7 THEN '정전. 감산 2024/3/5 결정' ELSE '한빛전자 2024년 3월 보고서' END AS text",
    ),
)
CONTEXTS = Rows(
    "nation",
    (
        "n_nationkey AS answer_id", "CASE n_nationkey % 4 WHEN 0 THEN '두리상사' WHEN 1 THEN '두리상사|없는회사' WHEN 2 THEN '' END AS targets", "CASE n_nationkey % 3 WHEN 0 THEN '한빛전자|두리상사|세움중공업' WHEN 1 THEN '한빛전자' ELSE '' END AS names", "CASE n_nationkey % 3 WHEN 1 THEN '사고' WHEN 2 THEN '파업|규제' ELSE '' END AS matched",
    ),
)


def _list(name: str):
    return F.filter(F.split(F.coalesce(name, F.lit("")), "[|]"), lambda x: x != "")


def _checked(spark, d):
    c = CLAIMS.df(spark, d)
    own, other = F.col("e1").cast("string"), F.col("e2").cast("string")
    cited = F.when(F.col("cites") == 0, F.array().cast("array<string>")).when(F.col("cites") == 1, F.array(F.lit("x"))).when(F.col("cites") < 4, F.array(own)).otherwise(F.array(other, F.lit("x"), own, other))
    sources = SOURCES.df(spark, d).withColumn("event_types", _list("types"))
    contexts = CONTEXTS.df(spark, d).select("answer_id", *[_list(x).alias(x) for x in ("targets", "names", "matched")])
    return claims.check(c.withColumn("cited", cited), sources, contexts)


def _iso(t: str) -> str:
    return rf"replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(\d{{4}})\s*년\s*(\d{{1,2}})\s*월\s*(\d{{1,2}})\s*일', '\1-#0\2-#0\3', 'g'), '\b(\d{{4}})[./](\d{{1,2}})[./](\d{{1,2}})\b', '\1-#0\2-#0\3', 'g'), '(\d{{4}})\s*년\s*(\d{{1,2}})\s*월', '\1-#0\2', 'g'), '#0(\d\d)', '\1', 'g'), '#', '')"


_ENDINGS = "했습니다|됐습니다|합니다|됩니다|입니다|하였다|되었다|했으며|했다|됐다|한다|된다|하는|되는|하고|되고|하여|하며|하기|되어|했고|이다|으로부터|에서는|에서도|에게서|으로는|이라는|에서|에게|으로|까지|부터|처럼|보다|마다|라는|에는|에도|와의|과의|이나|에|의|은|는|이|가|을|를|와|과|도|로|만"
_SKIPPED = "['발생','진행','기록','관련','제기','직면','상황','기업','회사','사례','경우','시작','완료','공식','규모','체계','이후','처음','보도','발표','확인','예정','가능','존재','대한','위한','있다','없다','있는','없는','있습니다','있으며','한다','했다']"
_NAME_STOP = "['주식회사','코퍼레이션','그룹','홀딩스','사건','관계','계약','co','ltd','inc']"
_CAUSES = "['로 인해','으로 인해','때문에','탓에','결과로','영향을 미','영향으로','여파로','초래','야기','때문','덕분에','따라 ','를 위해','을 위해']"


def _tokens(t: str) -> str:
    split = rf"string_split_regex(regexp_replace({t}, '\d{{4}}-\d{{2}}(?:-\d{{2}})?', ' ', 'g'), '[\s\-_·,.()\[\]「」『』/]+')"
    words = f"[regexp_replace(w, '^(.{{2,}}?)(?:{_ENDINGS})$', '\\1') for w in {split} if length(w) >= 2 AND NOT list_contains({_NAME_STOP}, lower(w))]"
    return rf"list_concat(regexp_extract_all({t}, '\d{{4}}-\d{{2}}(?:-\d{{2}})?'), [v for v in {words} if NOT list_contains({_NAME_STOP}, lower(v)) AND NOT list_contains({_SKIPPED}, v)])"


def _flat(t: str) -> str:
    return rf"lower(regexp_replace({t}, '\s+', '', 'g'))"


def _missing(tokens: str, flat: str) -> str:
    return f"[m for m in {tokens} if NOT contains({flat}, lower(m))]"


def _share(tokens: str, flat: str) -> str:
    return f"CASE WHEN len({tokens}) = 0 THEN 1.0 ELSE 1 - len({_missing(tokens, flat)}) / CAST(len({tokens}) AS DOUBLE) END"


_CHECKED = f"""
c AS (SELECT claim_id, answer_id, text, CASE WHEN cites = 0 THEN [] WHEN cites = 1 THEN ['x'] WHEN cites < 4 THEN [CAST(e1 AS VARCHAR)] ELSE [CAST(e2 AS VARCHAR), 'x', CAST(e1 AS VARCHAR)] END AS cited FROM {CLAIMS.sql}),
s AS (SELECT *, NOT missing AND regexp_replace(text, '\\s+', '', 'g') <> '' AS there, text || CASE WHEN published_at <> '' THEN chr(10) || published_at ELSE '' END AS shown, split_part(text, chr(10) || chr(10) || '— 「', 1) AS body FROM {SOURCES.sql}),
x AS (SELECT answer_id, [v for v in string_split(coalesce(targets, ''), '|') if v <> ''] AS targets, [v for v in string_split(names, '|') if v <> ''] AS names, [v for v in string_split(matched, '|') if v <> ''] AS matched FROM {CONTEXTS.sql}),
u AS (SELECT claim_id, unnest(cited) AS evidence_id, generate_subscripts(cited, 1) AS pos FROM c),
f AS (
    SELECT claim_id, string_agg(shown, chr(10) ORDER BY pos) FILTER (there) AS pool, list(shown ORDER BY pos) FILTER (there) AS shown, list(body ORDER BY pos) FILTER (there) AS bodies,
        list_distinct(flatten(list([v for v in string_split(coalesce(types, ''), '|') if v <> '' AND v <> '기타']))) AS types
    FROM u JOIN s USING (evidence_id) GROUP BY claim_id),
e AS (SELECT c.*, x.* EXCLUDE (answer_id), f.* EXCLUDE (claim_id), list_min([strpos(text, k) + length(k) for k in {_CAUSES} if contains(text, k)]) AS cut FROM c JOIN x USING (answer_id) LEFT JOIN f USING (claim_id)),
t AS (SELECT *, {_tokens(_iso("text"))} AS toks, {_flat(_iso("coalesce(pool, '')"))} AS flat, trim(coalesce(substr(text, cut), '')) AS effect FROM e),
w AS (SELECT *, {_tokens(_iso("effect"))} AS etoks, len(list_filter(targets, lambda v: contains(text, v))) > 0 AS aimed, [n for n in names if contains(text, n) AND len(list_filter(coalesce(bodies, []), lambda b: contains(b, n))) = 0] AS spoken FROM t),
k AS (SELECT claim_id, evidence_id, pos, unnest(parts) AS clause, generate_subscripts(parts, 1) AS idx FROM (SELECT claim_id, evidence_id, pos, [trim(p) for p in string_split_regex(text, '[.!?。\\n]+') if trim(p) <> ''] AS parts FROM u JOIN s USING (evidence_id) WHERE there)),
b AS (SELECT claim_id, evidence_id, clause, share FROM (SELECT k.*, {_share("w.toks", _flat(_iso("k.clause")))} AS share FROM k JOIN w USING (claim_id)) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY share DESC, pos, idx) = 1),
checked AS (
    SELECT w.claim_id, CASE WHEN len(cited) = 0 THEN 'uncited' WHEN pool IS NULL THEN 'no_text' ELSE 'scored' END AS status,
        CASE WHEN pool IS NOT NULL THEN {_share("toks", "flat")} END AS score, CASE WHEN pool IS NULL THEN [] ELSE {_missing("toks", "flat")} END AS missing,
        CASE WHEN effect = '' THEN NULL WHEN aimed THEN 'propagation' WHEN pool IS NULL THEN 'free_combination' WHEN len(etoks) > 0 AND {_share("etoks", "flat")} < 0.5 THEN 'free_combination' END AS claim_type,
        CASE WHEN effect <> '' AND NOT aimed AND pool IS NOT NULL AND len(etoks) > 0 THEN {_share("etoks", "flat")} END AS effect_score,
        CASE WHEN pool IS NULL THEN [] ELSE [n for n in spoken if len(list_filter(shown, lambda v: contains(v, n))) = 0] END AS misattributed,
        CASE WHEN pool IS NULL THEN [] ELSE [n for n in spoken if len(list_filter(shown, lambda v: contains(v, n))) > 0] END AS title_only,
        CASE WHEN len(matched) > 0 AND len(types) > 0 THEN len(list_intersect(types, matched)) > 0 END AS intent_linked,
        b.evidence_id AS best_evidence, b.clause AS best_clause, b.share AS best_share
    FROM w LEFT JOIN b ON w.claim_id = b.claim_id)
"""


@query(f"WITH {_CHECKED} SELECT * REPLACE (array_to_string(missing, ',') AS missing, array_to_string(misattributed, ',') AS misattributed, array_to_string(title_only, ',') AS title_only, round(score, 6) AS score, round(effect_score, 6) AS effect_score, round(best_share, 6) AS best_share) FROM checked", with_graph=False)
def claim_check(spark, d):
    joined = {c: F.array_join(c, ",") for c in ("missing", "misattributed", "title_only")}
    return _checked(spark, d).withColumns({**joined, **{c: F.round(c, 6) for c in ("score", "effect_score", "best_share")}})


@query(
    f"""WITH {_CHECKED} SELECT count(*) AS claims, count(*) FILTER (status = 'uncited') AS uncited, count(*) FILTER (status = 'no_text') AS no_text, count(score) AS scored,
    round(min(score), 3) AS min, round(avg(score), 3) AS mean, round(max(score), 3) AS max, count(*) FILTER (claim_type = 'propagation') AS propagation, count(*) FILTER (claim_type = 'free_combination') AS free_combination,
    count(*) FILTER (len(misattributed) > 0) AS misattributed, count(*) FILTER (len(title_only) > 0) AS title_only, count(*) FILTER (NOT intent_linked) AS unlinked, count(*) FILTER (intent_linked IS NULL) AS link_unknown FROM checked""",
    with_graph=False,
)
def claim_check_summary(spark, d):
    return claims.summary(_checked(spark, d))
