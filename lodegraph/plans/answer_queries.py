"""Contradictions, order, slots, cards, search and citations over the whole graph and its tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, articles
from ..sources import graph as G
from .record_queries import Rows, q
from .registry import WORKSPACE, query

LABELS = Rows("events", ("event_id", "event_id % 5 <> 0 AS is_risk", "CASE event_id % 6 WHEN 0 THEN '공장 생산 차질' WHEN 1 THEN '영업적자 소송' WHEN 2 THEN '신제품 출시' WHEN 3 THEN '협상 결렬과 파업' WHEN 4 THEN '공장 중단 지연' ELSE '소송 제기' END AS name", "CASE WHEN event_id % 13 > 0 THEN CAST(2018 + event_id % 7 AS STRING) || '-04-01' END AS occurred_at", "user_id AS e1", "user_id + 1 AS e2"))
SAID = Rows("customer", ("c_custkey AS evidence_id", "CASE c_custkey % 7 WHEN 0 THEN '2015년 3월 가동 재개' WHEN 1 THEN '앞서 2019년 흑자 전환과 확대' WHEN 2 THEN '차질 없이 정상' WHEN 3 THEN '' WHEN 4 THEN '노사 합의 타결, 당시 1999 년' WHEN 5 THEN '조기 완공' ELSE '공급 계약' END AS text", "c_custkey % 11 = 0 AS missing"))
_BLOB = f"own AS (SELECT event_id, string_agg(text, chr(10) ORDER BY evidence_id) AS blob FROM (SELECT DISTINCT event_id, unnest([e1, e2]) AS evidence_id FROM {LABELS.sql}) JOIN {SAID.sql} USING (evidence_id) WHERE NOT missing AND text <> '' GROUP BY event_id)"


def _labels(spark, d):
    return LABELS.df(spark, d).withColumn("evidence_ids", F.array("e1", "e2")).drop("e1", "e2")


_PAIRS = "MAP {" + ", ".join(f"'{w}': {q(o)}" for w, o in answers.OPPOSITES.items()) + "}"


@query(f"WITH {_BLOB}, f AS (SELECT event_id, blob, list_filter(list_filter({q(answers.RISK_LABELS)}, lambda w: contains(name, w)), lambda w: NOT contains(blob, w)) AS w FROM {LABELS.sql} JOIN own USING (event_id) WHERE is_risk), o AS (SELECT event_id, w, list_sort(list_distinct(list_filter(flatten(list_transform(w, lambda x: coalesce({_PAIRS}[x], []))), lambda x: contains(blob, x)))) AS o FROM f) SELECT event_id, array_to_string(w, ',') AS label_words, array_to_string(o, ',') AS evidence_words FROM o WHERE len(o) > 0", with_graph=False)
def polarity_flags(spark, d):
    f = answers.polarity_flags(_labels(spark, d), SAID.df(spark, d))
    return f.select("event_id", F.array_join("label_words", ",").alias("label_words"), F.array_join("evidence_words", ",").alias("evidence_words"))


@query(rf"WITH {_BLOB}, y AS (SELECT event_id, CAST(left(occurred_at, 4) AS INT) AS occurred_year, list_sort(list_distinct(list_transform(regexp_extract_all(blob, '((?:19|20)\d{{2}})\s*년', 1), lambda x: CAST(x AS INT)))) AS years, blob FROM {LABELS.sql} JOIN own USING (event_id) WHERE occurred_at IS NOT NULL) SELECT event_id, occurred_year, array_to_string(list_filter(years, lambda x: x < occurred_year - 1), ',') AS evidence_years, array_to_string(list_filter({q(answers.BACKGROUND)}, lambda w: contains(blob, w)), ',') AS markers FROM y WHERE len(list_filter(years, lambda x: x < occurred_year - 1)) > 0", with_graph=False)
def temporal_flags(spark, d):
    f = answers.temporal_flags(_labels(spark, d), SAID.df(spark, d))
    return f.select("event_id", "occurred_year", F.array_join(F.transform("evidence_years", lambda y: y.cast("string")), ",").alias("evidence_years"), F.array_join("markers", ",").alias("markers"))


_RINGED = "SELECT edge_id, src, tgt, type, score, CASE WHEN src IN :ws AND tgt IN :ws THEN 0 WHEN NOT (src IN :ws) AND NOT (tgt IN :ws) THEN 3 ELSE CASE WHEN NOT starts_with(CASE WHEN src IN :ws THEN tgt ELSE src END, 'P') THEN 1 ELSE 2 END END AS ring, type <> 'SUPPLIES_TO' AS a, NOT (src IN :ws) AS f FROM rel"
_RELATIONS = "rel AS (SELECT edge_id, src, tgt, type, confidence AS score FROM supplies UNION ALL SELECT src || '-' || tgt, src, tgt, type, 0.5 FROM simple_edges WHERE type = 'DEVELOPS')"


def _relations(spark, d):
    s = G.supplies(spark, d).select("edge_id", "src", "tgt", "type", F.col("confidence").alias("score"))
    v = G.simple_edges(spark, d).where("type = 'DEVELOPS'").select(F.concat("src", F.lit("-"), "tgt").alias("edge_id"), "src", "tgt", "type", F.lit(0.5).alias("score"))
    label = lambda c: F.when(F.col(c).startswith("P"), "Product").otherwise("Company")
    return s.unionByName(v).withColumn("src_label", label("src")).withColumn("tgt_label", label("tgt"))


@query(f"/*+with*/ {_RELATIONS} SELECT row_number() OVER (ORDER BY ring, a, f, score DESC, edge_id) AS pos, edge_id, ring FROM ({_RINGED}) ORDER BY pos LIMIT 80")
def ring_order(spark, d):
    return answers.in_rings(_relations(spark, d), WORKSPACE, types=("SUPPLIES_TO",), direction="outgoing").select("pos", "edge_id", "ring")


@query(f"/*+with*/ {_RELATIONS}, e AS (SELECT 'source' AS side, src AS key, score, edge_id FROM rel UNION ALL SELECT 'target', tgt, score, edge_id FROM rel), k AS (SELECT side, key, min(struct_pack(s := -score, e := edge_id)) AS first FROM e GROUP BY ALL) SELECT side, pos, key FROM (SELECT side, key, row_number() OVER (PARTITION BY side ORDER BY first, key) AS pos FROM k) WHERE pos <= 5")
def end_slots(spark, d):
    return answers.end_slots(_relations(spark, d))


CARDS = Rows("orders", ("o_orderkey AS card_id", "CASE o_orderkey % 7 WHEN 0 THEN 'shared_risk' WHEN 1 THEN 'inbound_risk' WHEN 2 THEN 'event_ongoing' WHEN 3 THEN 'contract_expiring' WHEN 4 THEN 'bottleneck' WHEN 5 THEN 'cascade_risk' ELSE 'shared_owner' END AS kind", "o_custkey % 9 AS shared", "o_custkey % 31 AS lift"))


@query(f"""WITH c AS (SELECT *, CASE WHEN kind IN ('shared_risk', 'cascade_risk') THEN 0 WHEN kind IN ('inbound_risk', 'event_ongoing', 'contract_expiring') THEN 1 ELSE 2 END AS g FROM {CARDS.sql}),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY shared DESC, lift DESC, kind, card_id) AS n, row_number() OVER (PARTITION BY kind ORDER BY shared DESC, lift DESC, kind, card_id) AS turn, list_position(['inbound_risk', 'event_ongoing', 'contract_expiring'], kind) AS k FROM c),
f AS (SELECT card_id, row_number() OVER (ORDER BY turn, k) AS o FROM r WHERE g = 1 QUALIFY row_number() OVER (ORDER BY turn, k) <= 3),
h AS (SELECT card_id, 0 AS part, n AS o FROM r WHERE g = 0 AND n <= 2 UNION ALL SELECT card_id, 1, o FROM f),
x AS (SELECT card_id, 2 AS part, row_number() OVER (ORDER BY shared DESC, lift DESC, kind, card_id) AS o FROM r WHERE card_id NOT IN (SELECT card_id FROM h))
SELECT row_number() OVER (ORDER BY part, o) AS pos, card_id FROM (SELECT * FROM h UNION ALL SELECT * FROM x) QUALIFY pos <= 10""", with_graph=False)
def card_order(spark, d):
    return answers.card_order(CARDS.df(spark, d))


_ALIASES = Rows("customer", ("'C' || CAST(c_custkey AS STRING) AS key", "'Old#00012' || CAST(c_custkey AS STRING) AS alias"), "c_custkey % 3 = 0")
_REGISTER = Rows("customer", ("'C' || CAST(c_custkey + 100 AS STRING) AS key", "c_name || 'a' AS name"))


@query(f"/*+with*/ deg AS (SELECT key, count(*) AS degree FROM (SELECT src AS key FROM supplies UNION ALL SELECT tgt FROM supplies) GROUP BY key), t AS (SELECT key, name, CASE WHEN lower(name) = 'customer#000000012' THEN 0 WHEN starts_with(lower(name), 'customer#000000012') THEN 1 WHEN contains(lower(name), 'customer#000000012') THEN 2 END AS tier FROM nodes), own AS (SELECT t.key, name, coalesce(tier, CASE WHEN a.key IS NOT NULL THEN 3 END) AS tier, true AS in_graph, coalesce(degree, 0) AS degree FROM t LEFT JOIN (SELECT DISTINCT key FROM {_ALIASES.sql} WHERE contains(lower(alias), 'customer#000000012')) a ON t.key = a.key LEFT JOIN deg ON t.key = deg.key), more AS (SELECT key, name, CASE WHEN starts_with(lower(name), 'customer#000000012') THEN 1 END AS tier, false, 0 FROM {_REGISTER.sql} WHERE key NOT IN (SELECT key FROM nodes)) SELECT * FROM (SELECT * FROM own WHERE tier IS NOT NULL UNION ALL SELECT * FROM more WHERE tier IS NOT NULL) ORDER BY in_graph DESC, tier, degree DESC, length(name), name, key LIMIT 20")
def name_search(spark, d):
    from ..operators import relations

    return answers.search(G.nodes(spark, d).select("key", "name"), _ALIASES.df(spark, d), _REGISTER.df(spark, d), relations.degrees(G.supplies(spark, d)), "Customer#000000012")


@query(f"/*+with*/ t AS (SELECT key, name FROM nodes) SELECT t.key, t.name, 3 AS tier FROM t JOIN (SELECT DISTINCT key FROM {_ALIASES.sql} WHERE contains(alias, '00012')) USING (key) WHERE NOT contains(lower(name), 'old#00012') ORDER BY length(name), name, key LIMIT 20")
def alias_search(spark, d):
    none = _REGISTER.df(spark, d).where("false")
    degrees = none.select("key", F.lit(0).cast("long").alias("degree"))
    return answers.search(G.nodes(spark, d).select("key", "name"), _ALIASES.df(spark, d), none, degrees, "old#00012").select("key", "name", "tier")


ALIAS_ROWS = Rows("part", ("'a' || CAST(p_partkey % 90 AS STRING) AS alias_key", "'c' || CAST(p_partkey % 70 AS STRING) AS canonical_key", "CASE WHEN p_partkey % 8 > 0 THEN p_name ELSE '' END AS canon_name"))
ASKED = Rows("part", ("p_partkey AS candidate", "CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'c' END || CAST(p_partkey % 100 AS STRING) AS k"))


@query(f"SELECT candidate, min(canon_name) AS name FROM {ASKED.sql} JOIN {ALIAS_ROWS.sql} ON k = alias_key OR k = canonical_key WHERE canon_name <> '' GROUP BY candidate", with_graph=False)
def alias_match(spark, d):
    return answers.alias_match(ASKED.df(spark, d), ALIAS_ROWS.df(spark, d))


RISK_LINKS = Rows("events", ("event_id % 500 AS event_id", "'C' || CAST(user_id % 40 AS STRING) AS company", "'d' || CAST(event_id % 77 AS STRING) AS source_doc"))


@query(f"SELECT event_id, count(DISTINCT company) FILTER (company IN :ws) AS firms, count(DISTINCT company) AS base, CAST(round(CAST(count(DISTINCT company) FILTER (company IN :ws) * 100 AS DECIMAL(28,6)) / count(DISTINCT company), 1) AS DOUBLE) AS coverage FROM {RISK_LINKS.sql} GROUP BY event_id HAVING count(DISTINCT company) FILTER (company IN :ws) >= 2", with_graph=False)
def shared_risk_coverage(spark, d):
    return answers.shared_risks(RISK_LINKS.df(spark, d), WORKSPACE)


@query(f"SELECT event_id, array_to_string(list_sort(list(DISTINCT source_doc)), ',') AS source_docs, count(DISTINCT source_doc) AS article_count FROM {RISK_LINKS.sql} GROUP BY event_id", with_graph=False)
def event_sources(spark, d):
    return answers.event_sources(RISK_LINKS.df(spark, d)).withColumn("source_docs", F.array_join("source_docs", ","))


MIXED = Rows("events", ("event_id", "user_id % 3 AS s1", "user_id % 2 AS s2", "CAST(event_id % 7 AS INT) AS m1", "CAST(event_id % 5 AS INT) AS m2", "event_id % 2 = 0 AS lined", "CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 3 AS INT) END AS article_count", "CASE WHEN event_id % 4 > 0 THEN 'd' || CAST(event_id % 4 AS STRING) END AS source_doc"))


@query(f"SELECT event_id, s AS signals FROM (SELECT event_id, concat_ws(',', CASE WHEN s1 <> s2 THEN 'S1' END, CASE WHEN abs(m1 - m2) >= 4 THEN 'S2' END, CASE WHEN lined AND coalesce(article_count, 0) <= 1 THEN 'S3' END, CASE WHEN source_doc NOT IN ('d1', 'd2') THEN 'S4' END, CASE WHEN m1 <> m2 THEN 'S5' END) AS s FROM {MIXED.sql}) WHERE s <> ''", with_graph=False)
def merge_signals(spark, d):
    e = MIXED.df(spark, d).select("event_id", F.array("s1", "s2").alias("subjects"), F.array("m1", "m2").alias("months"), F.when(F.col("lined"), F.array(F.lit("2024-01|x|1"))).otherwise(F.array().cast("array<string>")).alias("timeline"), "article_count", "source_doc", F.array(F.lit("d1"), F.lit("d2")).alias("source_docs"), F.array("m1", "m2").alias("years"))
    return answers.merge_signals(e).select("event_id", F.array_join("signals", ",").alias("signals"))


_some = lambda t, by: f"(SELECT key, string_agg(name, ' · ' ORDER BY r) AS x FROM (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY {by}) AS r FROM {t}) WHERE r <= 5 GROUP BY key)"


@query(f"/*+with*/ nm AS (SELECT key, name FROM nodes), p AS (SELECT DISTINCT src AS key, name FROM simple_edges JOIN nm ON tgt = nm.key WHERE type = 'DEVELOPS'), c AS (SELECT DISTINCT src AS key, name FROM supplies JOIN nm ON tgt = nm.key WHERE NOT suspect), v AS (SELECT DISTINCT tgt AS key, name FROM supplies JOIN nm ON src = nm.key WHERE NOT suspect) SELECT n.key, sha256(concat_ws(chr(10), n.name, '업종: ' || n.sector, '주요 제품·기술: ' || p_.x, '주요 고객: ' || c_.x, '주요 공급사: ' || v_.x)) AS digest FROM nodes n LEFT JOIN {_some('p', 'length(name) DESC, name')} p_ ON n.key = p_.key LEFT JOIN {_some('c', 'name')} c_ ON n.key = c_.key LEFT JOIN {_some('v', 'name')} v_ ON n.key = v_.key WHERE n.label = 'Company' AND n.key NOT LIKE '%4'")
def changed_cards(spark, d):
    """Cards of all firms; those of keys that end in 4 count as stored with the digest they have."""
    n, s = G.nodes(spark, d), G.supplies(spark, d).where("not suspect")
    name = n.select("key", "name")
    of = lambda e, own, other: e.select(F.col(own).alias("own"), F.col(other).alias("key")).join(name, "key").select(F.col("own").alias("key"), "name")
    cards = answers.company_cards(n.where("label = 'Company'"), of(G.simple_edges(spark, d).where("type = 'DEVELOPS'"), "src", "tgt"), of(s, "src", "tgt"), of(s, "tgt", "src"))
    stored = cards.where("key like '%4'").select("key", F.sha2("card", 256).alias("digest"))
    return answers.changed_cards(cards, stored).select("key", "digest")


CITING = Rows("events", ("event_id AS claim_id", "user_id AS a", "user_id + 3 AS b", "user_id AS c"))


@query(f"SELECT claim_id, CAST(pos AS INT) AS pos, evidence_id FROM (SELECT claim_id, unnest([0, 1]) AS pos, unnest([a, b]) AS evidence_id FROM {CITING.sql}) WHERE evidence_id IN (SELECT evidence_id FROM {SAID.sql} WHERE NOT missing)", with_graph=False)
def cited_sources(spark, d):
    claims = CITING.df(spark, d).select("claim_id", F.array("a", "b", "c").alias("cited"))
    return answers.cited(claims, SAID.df(spark, d))


CHECKED = Rows("events", ("CASE event_id % 5 WHEN 0 THEN 'uncited' WHEN 1 THEN 'no_text' ELSE 'scored' END AS status", "CASE WHEN event_id % 5 > 1 THEN (event_id % 97) / 97.0 END AS score"))


@query(f"SELECT count(*) AS claims, count(*) FILTER (status = 'uncited') AS uncited, count(*) FILTER (status = 'no_text') AS no_text, count(score) AS scored, round(min(score), 3) AS min, round(avg(score), 3) AS mean, round(max(score), 3) AS max FROM (SELECT status, CAST(score AS DOUBLE) AS score FROM {CHECKED.sql})", with_graph=False)
def claim_summary(spark, d):
    return answers.claim_summary(CHECKED.df(spark, d).withColumn("score", F.col("score").cast("double")))


@query(f"SELECT company AS key, listed, CASE WHEN NOT listed THEN 'unlisted' WHEN shares <= 0 OR shares > 20000000000 THEN 'unreliable_shares' WHEN stock_code % 4 = 0 THEN 'not_collected' END AS reason FROM (SELECT c_custkey AS company, c_custkey % 3 > 0 AS listed, c_custkey AS stock_code, CASE c_custkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 30000000000 ELSE 1000 END AS shares FROM customer)", with_graph=False)
def market_reasons(spark, d):
    c = G.table(spark, d, "customer").selectExpr("c_custkey AS key", "CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS stock_code", "CASE c_custkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 30000000000 ELSE 1000 END AS shares")
    prices = G.table(spark, d, "customer").where("c_custkey % 4 > 0").selectExpr("c_custkey AS stock_code")
    return answers.market_reason(c, prices)


@query("SELECT n.key, n.key IN (SELECT src FROM supplies) AS customers, n.key IN (SELECT tgt FROM supplies) AS vendors, n.key IN (SELECT src FROM simple_edges WHERE type = 'DEVELOPS') AS products, n.key IN (SELECT company FROM ev) AS events, n.key IN (SELECT tgt FROM simple_edges WHERE type = 'REGULATES') AS regulators, concat_ws(',', CASE WHEN n.key IN (SELECT src FROM supplies) THEN 'customers' END, CASE WHEN n.key IN (SELECT tgt FROM supplies) THEN 'vendors' END, CASE WHEN n.key IN (SELECT src FROM simple_edges WHERE type = 'DEVELOPS') THEN 'products' END, CASE WHEN n.key IN (SELECT company FROM ev) THEN 'events' END, CASE WHEN n.key IN (SELECT tgt FROM simple_edges WHERE type = 'REGULATES') THEN 'regulators' END) AS complete FROM nodes n WHERE label = 'Company'")
def company_blocks(spark, d):
    s, e = G.supplies(spark, d), G.simple_edges(spark, d)
    key = lambda df, c: df.select(F.col(c).alias("key"))
    out = answers.company_blocks(G.nodes(spark, d).where("label = 'Company'"), customers=key(s, "src"), vendors=key(s, "tgt"), products=key(e.where("type = 'DEVELOPS'"), "src"), events=key(G.events(spark, d), "company"), regulators=key(e.where("type = 'REGULATES'"), "tgt"))
    return out.withColumn("complete", F.array_join("complete", ","))


@query("SELECT row_number() OVER (ORDER BY first, evidence_id) AS pos, evidence_id FROM (SELECT evidence_id, min(struct_pack(l := l, o := o, a := a)) AS first FROM (SELECT 0 AS l, CAST(user_id AS STRING) AS o, 0 AS a, 'e' || CAST(event_id % 60 AS STRING) AS evidence_id FROM events UNION ALL SELECT 0, CAST(user_id AS STRING), 1, 'e' || CAST(event_id % 90 AS STRING) FROM events UNION ALL SELECT 1, CAST(o_custkey AS STRING), 0, 'e' || CAST(o_orderkey % 200 AS STRING) FROM orders) GROUP BY evidence_id)", with_graph=False)
def evidence_union(spark, d):
    e = G.table(spark, d, "events").select(F.col("user_id").cast("string").alias("owner"), F.array(*[F.concat(F.lit("e"), (F.col("event_id") % m).cast("string")) for m in (60, 90)]).alias("ids"))
    o = G.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("owner"), F.array(F.concat(F.lit("e"), (F.col("o_orderkey") % 200).cast("string"))).alias("ids"))
    return articles.evidence_union(e, o)


@query(f"SELECT event_id, array_to_string(list_distinct_order, ',') AS evidence_ids FROM (SELECT event_id, list(evidence_id ORDER BY f) AS list_distinct_order FROM (SELECT event_id, evidence_id, min(struct_pack(p := pos, a := a)) AS f FROM (SELECT event_id % 400 AS event_id, event_id AS pos, 0 AS a, 'e' || CAST(user_id % 5 AS STRING) AS evidence_id FROM events UNION ALL SELECT event_id % 400, event_id, 1, 'e' || CAST(user_id % 3 AS STRING) FROM events) GROUP BY ALL) GROUP BY event_id)", with_graph=False)
def merged_events(spark, d):
    e = G.table(spark, d, "events").select((F.col("event_id") % 400).alias("event_id"), F.col("event_id").alias("pos"), F.array(*[F.concat(F.lit("e"), (F.col("user_id") % m).cast("string")) for m in (5, 3)]).alias("evidence_ids"))
    return answers.merged_events(e).withColumn("evidence_ids", F.array_join("evidence_ids", ","))
