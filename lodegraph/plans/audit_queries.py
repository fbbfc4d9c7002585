"""Audits, market figures, news and documents, set operations and the insight patterns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S
from ..functions import edges as E
from ..functions import text as T
from ..functions import values as V
from ..operators import audits, consolidate, insight, relations
from ..sources import graph as G
from .graph_queries import r
from .registry import TODAY, WORKSPACE, query


def _count_sql(table: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS check_id, CAST(count(*) FILTER ({rule}) AS BIGINT) AS violations FROM {table}" for name, rule in checks.items())


@query(_count_sql("nodes", {
    "node_name_missing": "name IS NULL OR trim(name) = ''",
    "node_name_masked": "regexp_full_match(name, '[A-Za-z가-힣]사(\\s*(外|외|등))?')",
    "node_name_short": "length(trim(name)) <= 1 OR NOT regexp_matches(name, '\\pL')",
    "node_name_initial": "regexp_full_match(name, '([A-Za-z]{1,2}|[가-힣])사')",
    "node_name_sentence": "regexp_matches(name, '매출|기재|요청|영업비밀|중에서|선주|제조사|대형기업|공시유보')",
    "node_label_unknown": "label NOT IN ('Company', 'Person', 'Organization', 'Product', 'Event')",
    "company_named_as_group": "label = 'Company' AND regexp_matches(name, '조합원|노동조합|노조|위원회|협회|연맹')",
    "person_named_as_company": "label = 'Person'",
    "company_sector_missing": "label = 'Company' AND sector IS NULL",
}))
def audit_nodes(spark, d):
    return audits.count_checks(G.nodes(spark, d), audits.node_checks())


@query(_count_sql("supplies", {
    "edge_meta_missing": "source_type IS NULL OR confidence IS NULL OR is_current IS NULL",
    "edge_confidence_range": "confidence < 0 OR confidence > 1",
    "edge_validity_inverted": "valid_until < first_seen",
    "edge_seen_in_future": "last_seen > :today",
    "edge_self_loop": "src = tgt",
    "edge_subtype_blank": "type NOT IN ('DEVELOPS', 'HAS_EVENT', 'IMPACTS') AND (subtype IS NULL OR trim(subtype) IN ('', '.', '·', '-'))",
    "edge_supply_is_ownership": "type = 'SUPPLIES_TO' AND regexp_matches(subtype, '매각|전환사채|유상증자|신주|대여|차입|합병|청산|출자')",
    "edge_partner_is_supply": "type = 'PARTNERS_WITH' AND regexp_matches(subtype, '공급계약|납품|OEM|ODM')",
    "edge_source_missing": "source_doc IS NULL",
    "edge_last_seen_missing": "last_seen IS NULL",
    "edge_stage1_stale": "stage1 IS NOT NULL AND stage1 <> 'wrong_type' AND NOT coalesce(suspect, false)",
    "edge_type_unknown": "type NOT IN ('SUPPLIES_TO')",
    "edge_source_type_unknown": "source_type NOT IN ('dart', 'dart_filing', 'news')",
    "edge_suspect_unexplained": "suspect AND stage1 IS NULL",
}))
def audit_edges(spark, d):
    return audits.count_checks(G.supplies(spark, d), audits.edge_checks(TODAY))


@query("SELECT src, tgt, count(*) AS n FROM supplies GROUP BY src, tgt HAVING count(*) > 1")
def audit_parallel_edges(spark, d):
    return audits.duplicates(G.supplies(spark, d), ["src", "tgt"])


@query("SELECT n.key, n.label FROM nodes n WHERE n.label IN ('Company', 'Product') AND NOT EXISTS (SELECT 1 FROM supplies s WHERE s.src = n.key) AND NOT EXISTS (SELECT 1 FROM supplies s WHERE s.tgt = n.key)")
def audit_orphans(spark, d):
    return audits.orphans(G.nodes(spark, d).where("label in ('Company', 'Product')"), G.supplies(spark, d)).select("key", "label")


@query("SELECT edge_id, 'tgt' AS side, tgt AS key FROM supplies WHERE tgt NOT IN (SELECT key FROM nodes WHERE sector <> 'BUILDING')")
def audit_dangling(spark, d):
    known = G.nodes(spark, d).where("sector <> 'BUILDING'")
    return audits.dangling(G.supplies(spark, d), known)


@query("SELECT src, tgt, type, 'not_allowed' AS why FROM (SELECT src, tgt, type FROM simple_edges WHERE type = 'DEPENDS_ON' UNION ALL SELECT tgt, src, 'REGULATES' FROM simple_edges WHERE type = 'REGULATES') WHERE type = 'REGULATES'")
def audit_matrix(spark, d):
    e = G.simple_edges(spark, d)
    wrong = e.where("type = 'REGULATES'").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "type")
    rules = spark.createDataFrame([(x, a, b) for x, _, a, b in S.EDGE_RULES], "edge string, a string, b string")
    return audits.matrix_violations(e.where("type = 'DEPENDS_ON'").unionByName(wrong), G.nodes(spark, d), rules)


@query("SELECT key, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS key FROM supplies UNION ALL SELECT tgt FROM supplies) GROUP BY key HAVING count(*) > 150")
def audit_hubs(spark, d):
    return relations.degrees(G.supplies(spark, d)).where("degree > 150")


@query("WITH e AS (SELECT DISTINCT l_suppkey AS src, o_custkey AS tgt FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT a.src AS a, a.tgt AS b FROM e a JOIN e b ON a.src = b.tgt AND a.tgt = b.src WHERE a.src < a.tgt", with_graph=False)
def bidirectional_pairs(spark, d):
    """Firms that supply each other, a supplier and a customer of one number being one firm; all lines."""
    e = G.supply_lines(spark, d).select(F.col("l_suppkey").alias("a"), F.col("o_custkey").alias("b")).distinct()
    # a pair is bidirectional if its unordered form has both directions: one aggregate instead of a self-join
    both = e.where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count("*").alias("n")).where("n = 2")
    return both.select(F.col("x").alias("a"), F.col("y").alias("b"))


@query(f"""WITH price AS (SELECT c_custkey AS code, n_regionkey, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
fin AS (SELECT o_custkey AS code, year(o_orderdate) AS fin_year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(28,2)) AS profit FROM orders GROUP BY ALL),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY fin_year DESC) AS r FROM fin) WHERE r = 1)
SELECT p.code, CAST(l.fin_year AS INT) AS fin_year, CAST(CASE WHEN l.profit > 0 THEN round(CAST(CAST(p.c_acctbal AS DECIMAL(18,2)) * 1000 AS DECIMAL(28,6)) / CAST(l.profit AS DECIMAL(28,6)), 2) END AS DOUBLE) AS per,
  CAST(CASE WHEN l.revenue > 0 THEN round(CAST(CAST(p.c_acctbal AS DECIMAL(18,2)) * 1000 AS DECIMAL(28,6)) / CAST(l.revenue AS DECIMAL(28,6)), 2) END AS DOUBLE) AS psr,
  CASE WHEN l.fin_year IS NULL THEN 'no_financials' WHEN l.profit <= 0 THEN 'loss' END AS per_note FROM price p LEFT JOIN latest l ON p.code = l.code""", with_graph=False)
def market_ratios(spark, d):
    o = G.table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("fin_year"), F.col("o_totalprice").cast("decimal(18,2)").alias("t"), "o_orderstatus")
    fin = o.groupBy("code", "fin_year").agg(F.sum("t").alias("revenue"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("t")).otherwise(0)).alias("profit"))
    fin = consolidate.latest_per_group(fin, ["code"], [F.col("fin_year").desc()])
    cap = F.col("c_acctbal").cast("decimal(18,2)") * 1000
    p = G.table(spark, d, "customer").select(F.col("c_custkey").alias("code"), "c_acctbal").join(fin, "code", "left")
    note = F.when(F.col("fin_year").isNull(), "no_financials").when(F.col("profit") <= 0, "loss")
    return p.select("code", "fin_year", V.ratio(cap, F.col("profit")).alias("per"), V.ratio(cap, F.col("revenue")).alias("psr"), note.alias("per_note"))


@query("SELECT event_id, k, user_id, k > 50 AS high FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)", with_graph=False)
def json_props(spark, d):
    k = F.from_json("props", "k int")["k"]
    return G.table(spark, d, "events").select("event_id", k.alias("k"), "user_id", (k > 50).alias("high"))


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", with_graph=False)
def set_ops(spark, d):
    c, o = G.table(spark, d, "customer").select("c_custkey", "c_acctbal"), G.table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    key = lambda df: df.select(df.columns[0])
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return one("union", key(c.where("c_acctbal > 0")).union(key(o)).distinct()).union(one("except", key(c).subtract(key(o)))).union(one("intersect", key(c).intersect(key(o.where("o_orderstatus = 'P'")))))


@query("SELECT trim(text) AS text, min(doc_id) AS keep, count(*) AS n FROM documents GROUP BY trim(text) HAVING count(*) > 1", with_graph=False)
def dedup_text(spark, d):
    docs = G.table(spark, d, "documents").select("doc_id", F.trim("text").alias("text"))
    # grouped by digest: the texts stay out of the shuffle but for one per group and task
    g = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"), F.min("text").alias("text")).where("n > 1")
    return g.select("text", "keep", "n")


@query("""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(text, '[\\s\\-_·,.()\\[\\]「」『』/]+'), lambda w: length(w) >= 2 AND NOT list_contains(['주식회사','코퍼레이션','그룹','홀딩스','사건','관계','계약','co','ltd','inc'], lower(w)))) AS toks, lower(regexp_replace(text, '\\s+', '', 'g')) AS flat FROM benchmark)
SELECT a.item_id, b.item_id AS against, CAST(round(CAST(CASE WHEN len(a.toks) = 0 THEN 1.0 ELSE len(list_filter(a.toks, lambda w: contains(b.flat, lower(w)))) / CAST(len(a.toks) AS DOUBLE) END AS DECIMAL(28,10)), 6) AS DOUBLE) AS overlap FROM t a JOIN t b ON b.item_id = a.item_id + 1""", with_graph=False)
def token_overlap(spark, d):
    b = G.table(spark, d, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("against"), F.col("text").alias("other"))
    toks = F.array_distinct(T.name_tokens(F.col("text")))
    return b.join(nxt, "item_id").select("item_id", "against", E.three(T.overlap(F.col("other"), toks), 6).alias("overlap"))


_HEAD = "CASE o_orderkey % 6 WHEN 0 THEN '공정위, 납품단가 담합 제재' WHEN 1 THEN '지분 M&A 추진' WHEN 2 THEN '공장 화재와 리콜' WHEN 3 THEN '맑은 날씨' WHEN 4 THEN '자회사 소송' ELSE '파업에 생산차질' END"
_TOPIC = ", ".join(f"CASE WHEN regexp_matches(t, '{'|'.join(w.replace('&', '[&]') for w in words)}') THEN '{name}' END" for name, words in T.TOPICS.items())


@query(f"SELECT o_orderkey, concat_ws(',', {_TOPIC}) AS topics FROM (SELECT o_orderkey, {_HEAD} AS t FROM orders)", with_graph=False)
def topics_multi(spark, d):
    return G.table(spark, d, "orders").select("o_orderkey", F.array_join(T.topics(F.expr(_HEAD)), ",").alias("topics"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, array_to_string(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '.')[-2:], '.') AS domain FROM pages", with_graph=False)
def page_hosts(spark, d):
    h = T.host(F.col("url"))
    return G.table(spark, d, "pages").select("page_id", h.alias("host"), T.registrable_domain(h).alias("domain"))


def _markup_sql() -> str:
    t = "regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|nav|section|title)[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return f"SELECT page_id, length(body) AS n_chars, sha256(body) AS digest FROM (SELECT page_id, array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS body FROM pages)"


@query(_markup_sql(), with_graph=False)
def page_text(spark, d):
    body = T.strip_markup(F.col("html"))
    return G.table(spark, d, "pages").select("page_id", body.alias("b")).select("page_id", F.length("b").cast("long").alias("n_chars"), F.sha2("b", 256).alias("digest"))


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, length(text) AS n_chars, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM conversations", with_graph=False)
def conversation_window(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = G.table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.length("text").cast("long").alias("n_chars"), F.sum(F.length("text")).over(w.rowsBetween(-2, 0)).alias("recent"))


@query("SELECT quality, toxic, count(*) AS n, count(*) FILTER (n_chars < 1000) AS short FROM labels JOIN documents USING (doc_id) GROUP BY ALL", with_graph=False)
def label_agreement(spark, d):
    j = G.table(spark, d, "labels").join(G.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 1000).alias("short"))


@query("SELECT edge_id, 'ev_' || substr(sha1(concat_ws('|', source_doc, src, tgt, type, coalesce(subtype, ''))), 1, 16) AS evidence_id FROM supplies")
def evidence_ids(spark, d):
    e = G.supplies(spark, d)
    return e.select("edge_id", V.stable_id("ev_", 16, *[F.col(c) for c in ("source_doc", "src", "tgt", "type", "subtype")]).alias("evidence_id"))


@query("""/*+with*/ old AS (SELECT src, tgt, min(first_seen) AS first_seen, count(*) AS seen, max(last_seen) AS last_seen FROM supplies WHERE subtype <> 'N' GROUP BY ALL), new AS (SELECT src, tgt, min(first_seen) AS first_seen, count(*) AS seen, max(last_seen) AS last_seen FROM supplies WHERE subtype = 'N' GROUP BY ALL)
SELECT coalesce(o.src, n.src) AS src, coalesce(o.tgt, n.tgt) AS tgt, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(o.seen, 0) + coalesce(n.seen, 0) AS seen, greatest(o.last_seen, n.last_seen) AS last_seen FROM old o FULL JOIN new n ON o.src = n.src AND o.tgt = n.tgt""")
def upsert_edges(spark, d):
    e = G.supplies(spark, d)
    part = lambda x: x.groupBy("src", "tgt").agg(F.min("first_seen").alias("first_seen"), F.count("*").alias("seen"), F.max("last_seen").alias("last_seen"))
    return consolidate.upsert(part(e.where("subtype <> 'N'")), part(e.where("subtype = 'N'")), ["src", "tgt"], first=["first_seen"], add=["seen"], most=["last_seen"])


@query("SELECT 'S' || (l_suppkey // 2 * 2) AS src, 'C' || o_custkey AS tgt, count(*) AS n FROM (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ALL", with_graph=False)
def remap_edges(spark, d):
    e = G.supply_lines(spark, d).select("l_suppkey", "o_custkey").distinct()
    s = G.table(spark, d, "supplier").where("s_suppkey % 2 = 1").select(G.key("S", "s_suppkey").alias("old"), F.concat(F.lit("S"), (F.col("s_suppkey") - 1).cast("string")).alias("keep"))
    named = e.select(G.key("S", "l_suppkey").alias("src"), G.key("C", "o_custkey").alias("tgt"))
    return consolidate.remap(named, s).groupBy("src", "tgt").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN suspect THEN 'archive' ELSE 'keep' END AS part, count(*) AS n, count(DISTINCT src) AS sources FROM supplies GROUP BY ALL")
def purge_split(spark, d):
    return G.supplies(spark, d).groupBy(F.when(F.col("suspect"), "archive").otherwise("keep").alias("part")).agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


@query("SELECT edge_id, CASE WHEN corroboration > 1 AND corroboration <= 5 THEN corroboration END AS amount, CAST(round(CAST(confidence AS DECIMAL(28,10)), 3) AS DOUBLE) AS ratio FROM supplies")
def numeric_guard(spark, d):
    e = G.supplies(spark, d)
    return e.select("edge_id", V.plausible(F.col("corroboration"), F.col("type").isin("SUPPLIES_TO", "ACQUIRES"), 1, 5).alias("amount"), E.three(F.col("confidence")).alias("ratio"))


# Patterns of the insight candidates.


@query("SELECT tgt AS customer, count(DISTINCT src) AS n FROM supplies WHERE src IN :ws GROUP BY tgt HAVING count(DISTINCT src) >= 2")
def pattern_shared_customer(spark, d):
    return G.supplies(spark, d).where(F.col("src").isin(*WORKSPACE)).groupBy(F.col("tgt").alias("customer")).agg(F.count_distinct("src").alias("n")).where("n >= 2")


@query("SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) <= 20", with_graph=False)
def pattern_no_alternative(spark, d):
    return G.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count_distinct("l_suppkey").alias("suppliers")).where("suppliers <= 20")


@query("SELECT 'C' || o_custkey AS company, count(DISTINCT year(o_orderdate)) AS years, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(DISTINCT year(o_orderdate)) >= 2", with_graph=False)
def recurrence_years(spark, d):
    o = G.table(spark, d, "orders")
    return o.groupBy(G.key("C", "o_custkey").alias("company")).agg(F.count_distinct(F.year("o_orderdate")).alias("years"), F.count("*").alias("orders")).where("years >= 2")


@query("SELECT key FROM nodes WHERE label = 'Company' AND key LIKE 'C%' AND key NOT IN (SELECT company FROM ev)")
def silent_firms(spark, d):
    n = G.nodes(spark, d).where("label = 'Company' and key like 'C%'").select("key")
    return n.join(G.events(spark, d).select(F.col("company").alias("key")).distinct(), "key", "left_anti")


@query("SELECT src, tgt, CAST(sum(corroboration) AS BIGINT) AS orders FROM supplies GROUP BY src, tgt HAVING sum(corroboration) = 1")
def thin_evidence(spark, d):
    return G.supplies(spark, d).groupBy("src", "tgt").agg(F.sum("corroboration").alias("orders")).where("orders = 1")


@query("/*+with*/ c AS (SELECT tgt, src, sum(corroboration) AS n FROM supplies GROUP BY ALL) SELECT tgt AS company, src AS supplier, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY tgt) AS total, row_number() OVER (PARTITION BY tgt ORDER BY n DESC, src) AS r FROM c) WHERE r = 1 AND n * 100 >= 5 * total")
def hidden_concentration(spark, d):
    pairs = G.supplies(spark, d).groupBy("tgt", "src").agg(F.sum("corroboration").alias("n"))
    top = pairs.groupBy("tgt").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "src")).alias("b"))
    return top.select(F.col("tgt").alias("company"), F.col("b.src").alias("supplier"), (-F.col("b.m")).alias("n"), "total").where("n * 100 >= 5 * total")


@query("SELECT a.company AS a, b.company AS b, count(*) AS n FROM (SELECT DISTINCT company, event_type, occurred_at FROM ev WHERE is_risk AND company IN ('C1', 'C2', 'C4', 'C7', 'C10')) a JOIN (SELECT DISTINCT company, event_type, occurred_at FROM ev WHERE is_risk AND company IN ('C1', 'C2', 'C4', 'C7', 'C10')) b ON a.event_type = b.event_type AND a.occurred_at = b.occurred_at AND a.company < b.company GROUP BY ALL")
def shared_risk(spark, d):
    e = G.events(spark, d).where(F.col("is_risk") & F.col("company").isin("C1", "C2", "C4", "C7", "C10")).select("company", "event_type", "occurred_at").distinct()
    return e.alias("a").join(e.alias("b"), ["event_type", "occurred_at"]).where("a.company < b.company").groupBy(F.col("a.company").alias("a"), F.col("b.company").alias("b")).agg(F.count("*").alias("n"))


@query("SELECT n.key AS regulator, count(*) AS firms, list_sort(list(e.tgt))[1:5] AS some FROM simple_edges e JOIN nodes n ON e.src = n.key WHERE e.type = 'REGULATES' GROUP BY n.key HAVING count(*) >= 2")
def shared_regulator(spark, d):
    e = G.simple_edges(spark, d).where("type = 'REGULATES'")
    five = relations.top_per_key(e, ["src"], [F.col("tgt")], 5).groupBy("src").agg(F.array_sort(F.collect_list("tgt")).alias("some"))
    return e.groupBy("src").agg(F.count("*").alias("firms")).where("firms >= 2").join(five, "src").select(F.col("src").alias("regulator"), "firms", "some")


@query("SELECT event_type, month, n, CAST(n - lag(n, 1, 0) OVER (PARTITION BY event_type ORDER BY month) AS BIGINT) AS change FROM (SELECT event_type, substr(occurred_at, 1, 7) AS month, count(*) AS n FROM ev GROUP BY ALL)")
def type_skew(spark, d):
    g = G.events(spark, d).groupBy("event_type", F.substring("occurred_at", 1, 7).alias("month")).agg(F.count("*").alias("n"))
    return g.withColumn("change", F.col("n") - F.lag("n", 1, 0).over(W.partitionBy("event_type").orderBy("month")))


@query(f"SELECT event_type, CAST(quantile_cont(value, 0.5) AS DOUBLE) AS p50, {r('quantile_cont(value, 0.75)', 4)} AS p75, {r('quantile_cont(value, 0.9)', 4)} AS p90 FROM events GROUP BY event_type", with_graph=False)
def value_percentiles(spark, d):
    p = lambda q: F.percentile("value", F.lit(q))
    return G.table(spark, d, "events").groupBy("event_type").agg(p(0.5).alias("p50"), E.three(p(0.75), 4).alias("p75"), E.three(p(0.9), 4).alias("p90"))


@query("SELECT label, sha1(string_agg(part, ',' ORDER BY block)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM (SELECT label, vec_id // 1000 AS block, sha1(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id)) AS part, count(*) AS n FROM embeddings GROUP BY ALL) GROUP BY label", with_graph=False)
def ranking_fingerprint(spark, d):
    """A digest of each label's ids: ranges of a thousand ids are digested in many tasks, then their digests in order."""
    e = G.table(spark, d, "embeddings").groupBy("label", F.expr("vec_id div 1000").alias("block"))
    part = lambda c: F.sha1(F.array_join(c, ",").cast("binary"))
    blocks = e.agg(part(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: v.cast("string"))).alias("part"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda b: b["part"])
    return blocks.groupBy("label").agg(part(ordered).alias("fingerprint"), F.sum("n").alias("n"))


@query("SELECT type, category, count(*) AS n FROM (SELECT type, CASE type WHEN 'SUPPLIES_TO' THEN 'trade' WHEN 'DEVELOPS' THEN 'product' WHEN 'DEPENDS_ON' THEN 'product' WHEN 'REGULATES' THEN 'risk' END AS category FROM (SELECT type FROM supplies UNION ALL SELECT type FROM simple_edges)) GROUP BY ALL")
def graph_profile(spark, d):
    e = G.supplies(spark, d).select("type").unionByName(G.simple_edges(spark, d).select("type"))
    return e.groupBy("type").agg(F.count("*").alias("n")).withColumn("category", E.category())


@query("SELECT e.company AS key, count(*) AS events, CAST(count(*) FILTER (is_risk) AS BIGINT) AS risks, any_value(s.n) AS suppliers, CASE WHEN any_value(s.n) IS NULL THEN 'events_only' ELSE 'full' END AS detail FROM ev e LEFT JOIN (SELECT tgt, count(DISTINCT src) AS n FROM supplies GROUP BY tgt) s ON e.company = s.tgt GROUP BY e.company")
def company_detail(spark, d):
    # each branch is aggregated before the join, so branches never multiply
    e = G.events(spark, d).groupBy(F.col("company").alias("key")).agg(F.count("*").alias("events"), F.count_if("is_risk").alias("risks"))
    s = G.supplies(spark, d).groupBy(F.col("tgt").alias("key")).agg(F.count_distinct("src").alias("suppliers"))
    return e.join(s, "key", "left").withColumn("detail", F.when(F.col("suppliers").isNull(), "events_only").otherwise("full"))


@query("SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars >= 500 AND lang = 'en') WHERE r <= 5", with_graph=False)
def news_feed(spark, d):
    docs = G.table(spark, d, "documents").where("n_chars >= 500 and lang = 'en'").select("doc_id", "source", "lang", "n_chars")
    return relations.top_per_key(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 5).select("doc_id", "source", "lang")


@query("WITH p AS (SELECT page_id, array_to_string(string_split(regexp_extract(url, '://([^/:?#]+)', 1), '.')[-2:], '.') AS domain, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS lang FROM pages), v AS (SELECT domain, lang, count(*) AS n FROM p GROUP BY ALL), top AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY domain) AS total, row_number() OVER (PARTITION BY domain ORDER BY n DESC, lang) AS r FROM v) WHERE r = 1) SELECT page_id, CASE WHEN n >= 2 AND 2 * n >= total THEN top.lang END AS majority FROM p JOIN top USING (domain)", with_graph=False)
def majority_vote(spark, d):
    p = G.table(spark, d, "pages").select("page_id", T.registrable_domain(T.host(F.col("url"))).alias("domain"), F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1).alias("lang"))
    v = p.groupBy("domain", "lang").agg(F.count("*").alias("n"))
    top = v.groupBy("domain").agg(F.min(F.struct((-F.col("n")).alias("m"), "lang")).alias("b"), F.sum("n").alias("total"))
    sure = (-F.col("b.m") >= 2) & (-2 * F.col("b.m") >= F.col("total"))
    return p.join(top, "domain").select("page_id", F.when(sure, F.col("b.lang")).alias("majority"))


@query("SELECT turn, kind, event_id FROM (SELECT row_number() OVER (PARTITION BY event_type ORDER BY occurred_at DESC, event_id) AS turn, event_type AS kind, event_id FROM ev) WHERE turn <= 12 ORDER BY turn, array_position(['error', 'purchase', 'signup', 'view', 'click'], kind) LIMIT 12")
def insight_cards(spark, d):
    kinds = ("error", "purchase", "signup", "view", "click")
    e = G.events(spark, d).withColumnRenamed("event_type", "kind")
    return insight.round_robin(e, "kind", [F.col("occurred_at").desc(), F.col("event_id")], kinds, 12).select("turn", "kind", "event_id")
