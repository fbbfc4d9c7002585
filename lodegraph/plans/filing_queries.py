"""Disclosure rows as edges, and repairs of keys, types and events, over rows shaped from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import vocabulary as V
from ..operators import filings, repairs
from ..sources import graph as G
from .registry import query


@query("""WITH r AS (SELECT 'P' || l_partkey AS corp, l_suppkey AS s, l_suppkey % 2 = 0 AS firm, CASE l_returnflag WHEN 'R' THEN '본인' WHEN 'A' THEN '친인척' END AS relation, l_linenumber % 2 = 1 AS common, CAST(round(l_discount * 100) AS DOUBLE) AS percent, l_orderkey * 10 + l_linenumber AS place FROM lineitem),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corp, s ORDER BY common DESC, percent DESC, place) AS n FROM r) WHERE n = 1)
SELECT CASE WHEN firm THEN 'supplier' || s ELSE 'Holder ' || s || '@' || corp END AS src, corp AS tgt, CASE WHEN relation = '친인척' THEN '특수관계인' ELSE '최대주주' END AS subtype, percent, CAST(place AS VARCHAR) AS doc FROM b WHERE firm OR percent >= 5 OR relation = '본인'""", with_graph=False)
def holder_stakes(spark, d):
    x = G.table(spark, d, "lineitem")
    name = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"), F.lit(" 주식회사"))).otherwise(G.key("Holder ", "l_suppkey"))
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = x.select(
        G.key("P", "l_partkey").alias("corp"), name.alias("name"), F.when(F.col("l_returnflag") == "R", "본인").when(F.col("l_returnflag") == "A", "친인척").alias("relation"), F.when(F.col("l_linenumber") % 2 == 1, "보통주").otherwise("우선주").alias("stock"),
        F.round(F.col("l_discount") * 100).alias("percent"), F.lit(None).cast("double").alias("percent_before"), F.lit(None).cast("long").alias("shares"), F.lit(None).cast("long").alias("shares_before"), place.cast("string").alias("doc"), F.lit(None).cast("string").alias("day"), place.alias("place"),
    )
    return filings.holder_edges(rows).select("src", "tgt", "subtype", "percent", "doc")


@query("""WITH r AS (SELECT *, c_nationkey % 3 AS kind, c_custkey % 24 AS months FROM customer)
SELECT c_name || '|1960-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') AS src, 'N' || c_nationkey AS tgt, CASE WHEN kind = 2 THEN '사외이사' WHEN c_custkey % 2 = 0 THEN '상무' ELSE '부사장' END AS subtype, months < 12 AS is_new FROM r WHERE kind <> 1 OR c_custkey % 2 = 1""", with_graph=False)
def executive_posts(spark, d):
    c = G.table(spark, d, "customer")
    kind, none = F.col("c_nationkey") % 3, F.lit(None).cast("string")
    rows = c.select(
        G.key("N", "c_nationkey").alias("corp"), F.col("c_name").alias("name"), F.when(kind == 0, "사내이사").when(kind == 1, "미등기").otherwise("사외이사").alias("registered"), F.when(F.col("c_custkey") % 2 == 0, "상무").otherwise("부사장").alias("position"),
        F.concat(F.lit("1960년 "), (F.col("c_custkey") % 12 + 1).cast("string"), F.lit("월")).alias("birth"), F.concat((F.col("c_custkey") % 24).cast("string"), F.lit("개월")).alias("tenure"), none.alias("career"), none.alias("doc"), none.alias("day"),
    )
    return filings.executive_edges(rows).select("src", "tgt", "subtype", "is_new")


@query("SELECT 'C' || o_custkey AS src, 'firm' || (o_orderkey % 100) AS tgt, CASE WHEN o_orderkey % 101 > 50 THEN '자회사' ELSE '출자' END AS subtype, o_orderkey % 101 > o_orderkey % 7 * 10 AS increased, strftime(o_orderdate, '%Y-%m-%d') AS valid_from, CAST(o_orderkey AS VARCHAR) AS doc FROM orders", with_graph=False)
def investment_stakes(spark, d):
    k = F.col("o_orderkey")
    rows = G.table(spark, d, "orders").select(G.key("C", "o_custkey").alias("corp"), F.concat(F.lit("Firm "), (k % 100).cast("string"), F.lit(" Co., Ltd.")).alias("name"), (k % 101).cast("double").alias("percent"), (k % 7 * 10).cast("double").alias("percent_before"), F.date_format("o_orderdate", "yyyy.MM.dd").alias("acquired"), k.cast("string").alias("doc"), F.lit(None).cast("string").alias("day"))
    return filings.investment_edges(rows).select("src", "tgt", "subtype", "increased", "valid_from", "doc")


@query("SELECT 'Holder ' || h || '@N' || n AS src, 'N' || n AS tgt, percent, strftime(o_orderdate, '%Y-%m-%d') AS valid_from, CAST(o_orderkey AS VARCHAR) AS doc FROM (SELECT *, row_number() OVER (PARTITION BY n, h ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS r FROM (SELECT *, o_custkey % 50 AS n, o_custkey % 11 AS h, CAST(o_orderkey % 10 AS DOUBLE) AS percent FROM orders)) WHERE r = 1", with_graph=False)
def bulk_holdings(spark, d):
    k = F.col("o_orderkey")
    rows = G.table(spark, d, "orders").select(F.concat(F.lit("N"), (F.col("o_custkey") % 50).cast("string")).alias("corp"), F.concat(F.lit("Holder "), (F.col("o_custkey") % 11).cast("string")).alias("name"), (k % 10).cast("double").alias("percent"), F.date_format("o_orderdate", "yyyyMMdd").alias("reported"), F.lit("-").alias("reason"), k.cast("string").alias("doc"), k.alias("place"))
    return filings.bulk_edges(rows).select("src", "tgt", "percent", "valid_from", "doc")


@query("SELECT 'F' || o_orderstatus AS src, 'customer' || o_custkey AS tgt, o_orderkey AS amount, CAST(round(CAST(o_orderkey % 100 AS DECIMAL(10,4)) / 100, 4) AS DOUBLE) AS revenue_ratio, strftime(o_orderdate, '%Y-%m-%d') AS valid_from FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS r FROM orders) WHERE r = 1", with_graph=False)
def supply_contracts(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    form = F.format_string("<p>계약상대방 Customer %d (Customer Inc.)</p> 최근 매출액(원) 9 계약금액(원) %,d 매출액대비(%%) %d 계약기간 시작일 %s 종료일 2030-01-01", F.col("o_custkey"), k, k % 100, day)
    docs = G.table(spark, d, "orders").select(G.key("F", "o_orderstatus").alias("corp"), k.cast("string").alias("doc"), day.alias("reported"), k.alias("place"), form.alias("text"))
    return filings.contract_edges(docs).select("src", "tgt", "amount", "revenue_ratio", "valid_from")


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN '수주' WHEN 'signup' THEN '공급' WHEN 'error' THEN '' ELSE event_type END AS form FROM events", with_graph=False)
def subtype_forms(spark, d):
    said = F.when(F.col("event_type") == "purchase", "Purchase order").when(F.col("event_type") == "signup", "new-customer").when(F.col("event_type") == "error", " OTHER ").otherwise(F.col("event_type"))
    return G.table(spark, d, "events").select("event_id", V.canonical_subtype(F.lit("SUPPLIES_TO"), said).alias("form"))


_SPELT = "CASE l_linenumber % 3 WHEN 0 THEN 'Bulk Order' WHEN 1 THEN 'bulk-order' ELSE 'bulkorder' END || ' ' || l_returnflag"


@query(f"WITH c AS (SELECT {_SPELT} AS subtype, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT flag, arg_max(subtype, struct_pack(a := n, b := length(subtype), c := subtype)) AS keep FROM c GROUP BY flag) SELECT subtype, keep FROM c JOIN b USING (flag) WHERE subtype <> keep", with_graph=False)
def subtype_convergence(spark, d):
    c = G.table(spark, d, "lineitem").groupBy(F.expr(_SPELT).alias("subtype")).agg(F.count("*").alias("n")).withColumn("type", F.lit("SUPPLIES_TO"))
    return repairs.convergent_subtypes(c, F.lit(False)).select("subtype", "keep")


@query("SELECT 'U' || c_custkey AS key, 'C' || c_custkey AS parent, '반도체사업부' AS unit FROM customer", with_graph=False)
def business_units(spark, d):
    c = G.table(spark, d, "customer")
    units = c.select(G.key("U", "c_custkey").alias("key"), F.concat("c_name", F.lit(" 반도체사업부")).alias("name"))
    return repairs.units_of_parents(units, c.select(G.key("C", "c_custkey").alias("key"), F.col("c_name").alias("name")))


@query("SELECT 'C/' || c_custkey AS old, 'C' || c_custkey AS keep FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)", with_graph=False)
def slash_keys(spark, d):
    c = G.table(spark, d, "customer").select(G.key("C/", "c_custkey").alias("key"))
    return repairs.free_of_slashes(c.unionByName(G.table(spark, d, "supplier").select(G.key("C", "s_suppkey").alias("key"))))


@query("SELECT c_mktsegment || c_nationkey AS key, count(*) AS n_codes FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 1 AND count(*) FILTER (c_acctbal > 9000) <> 1", with_graph=False)
def ambiguous_names(spark, d):
    c = G.table(spark, d, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("key"), F.col("c_custkey").cast("string").alias("code"), (F.col("c_acctbal") > 9000).alias("listed"))
    return repairs.ambiguous_firms(c).select("key", F.size("codes").cast("long").alias("n_codes"))


@query("""SELECT src, tgt, type, CASE type WHEN 'DEVELOPS' THEN 'retype' WHEN 'DEPENDS_ON' THEN 'flip' ELSE 'reject' END AS action, CASE type WHEN 'DEVELOPS' THEN 'DEPENDS_ON' WHEN 'DEPENDS_ON' THEN 'IMPACTS' ELSE type END AS new_type FROM (SELECT src, CASE WHEN type = 'DEPENDS_ON' THEN 'E' || tgt ELSE tgt END AS tgt, type FROM simple_edges)""")
def retype_actions(spark, d):
    kind = F.col("type")
    e = G.simple_edges(spark, d).withColumn("tgt", F.when(kind == "DEPENDS_ON", F.concat(F.lit("E"), "tgt")).otherwise(F.col("tgt")))
    hint = F.when(kind == "DEVELOPS", "DEPENDS_ON").when(kind == "DEPENDS_ON", "IMPACTS").otherwise("ACQUIRES")
    label = lambda c: F.when(F.col(c).like("P%"), "Product").when(F.col(c).like("N%"), "Organization").when(F.col(c).like("E%"), "Event").otherwise("Company")
    rules = spark.createDataFrame([(x, a, b) for x, _, a, b in S.EDGE_RULES], "edge string, a string, b string")
    marked = e.select("src", "tgt", "type", label("src").alias("src_label"), label("tgt").alias("tgt_label"), hint.alias("hint"))
    return repairs.retype_action(marked, rules).select("src", "tgt", "type", "action", "new_type")


@query("""WITH f AS (SELECT l_partkey AS p, l_orderkey AS o, min(l_returnflag) AS label FROM lineitem GROUP BY ALL), g AS (SELECT p, label, list_sort(list('D' || o)) AS docs FROM f GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY p) AS k, row_number() OVER (PARTITION BY p ORDER BY len(docs) DESC, label) AS r FROM g)
SELECT 'E' || p AS event_id, label, CASE WHEN r = 1 THEN 'E' || p ELSE 'evt_split_' || substr(sha1('E' || p || '|' || label || '|' || array_to_string(docs, '|')), 1, 12) END AS new_id, len(docs) AS n_docs FROM r WHERE k > 1""", with_graph=False)
def event_splits(spark, d):
    v = G.table(spark, d, "lineitem").select(G.key("E", "l_partkey").alias("event_id"), F.col("l_returnflag").alias("label"), G.key("D", "l_orderkey").alias("doc"))
    keys, _ = repairs.split_events(v, v.select("event_id", "doc"))
    return keys.select("event_id", "label", "new_id", F.size("docs").cast("long").alias("n_docs"))
