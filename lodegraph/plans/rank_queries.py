"""Ranking, selection, retrieval and resolution, over events, embeddings and names."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import edges as E
from ..functions import text as T
from ..functions import values as V
from ..operators import consolidate, ranking, relations, resolution, retrieval
from ..sources import graph as G
from .graph_queries import r
from .registry import WORKSPACE, query


@query("""SELECT label, vec_id, rrf_rank, CAST(round(CAST(rrf AS DECIMAL(28,10)), 8) AS DOUBLE) AS rrf FROM (
  SELECT label, vec_id, rrf, row_number() OVER (PARTITION BY label ORDER BY round(CAST(rrf AS DECIMAL(28,10)), 8) DESC, vec_id) AS rrf_rank FROM (
  SELECT label, vec_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY label ORDER BY embedding[2] DESC, vec_id)) AS rrf FROM embeddings)) WHERE rrf_rank <= 20""", with_graph=False)
def rrf_fusion(spark, d):
    e = G.table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    one = lambda c, name: e.select("label", "vec_id", F.col(c).cast("double").alias("score"), F.col("vec_id").alias("pos"), F.lit(name).alias("list"))
    lists = ranking.ranked(one("x", "graph").unionByName(one("y", "vector")), ["label", "list"], "vec_id", "score", "pos")
    fused = ranking.rrf(lists, ["label"], "vec_id").withColumn("rrf", E.three(F.col("rrf"), 8))
    return relations.top_per_key(fused, ["label"], [F.col("rrf").desc(), F.col("vec_id")], 20).withColumn("rrf_rank", F.row_number().over(W.partitionBy("label").orderBy(F.col("rrf").desc(), "vec_id")))


_TIER = "CASE WHEN event_type IN ('error', 'purchase') THEN 0 ELSE 1 END"
_ORDER = f"{_TIER}, CASE WHEN is_risk THEN 0 ELSE 1 END, CASE WHEN occurred_at >= '2024-01-20' THEN 0 ELSE 1 END, CAST(round_even(k / 100.0::DOUBLE / 0.05::DOUBLE, 0) AS INT) DESC, CASE WHEN is_risk THEN 0 ELSE 1 END, occurred_at DESC, event_id"


@query(f"SELECT company, event_id, event_type, CAST(seat AS INT) AS seat FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY {_ORDER}) AS seat FROM ev) WHERE seat <= 10")
def tiered_select(spark, d):
    e = G.events(spark, d).withColumn("similarity", F.col("k") / 100.0)
    order = ranking.event_order(("error", "purchase"), risk_wanted=True, since="2024-01-20")
    return e.withColumn("seat", F.row_number().over(W.partitionBy("company").orderBy(*order))).where("seat <= 10").select("company", "event_id", "event_type", "seat")


@query("""/*+with*/ s AS (SELECT event_type, event_id, occurred_at, CASE WHEN CAST(substr(company, 2) AS INT) < 40 THEN 0 ELSE 1 END AS side, CASE WHEN is_risk THEN 0 ELSE 1 END AS tier FROM ev),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, tier, side ORDER BY occurred_at DESC, event_id) AS k FROM s)
SELECT event_type, event_id, CAST(seat AS INT) AS seat FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY tier, 2 * k + side, occurred_at DESC, event_id) AS seat FROM k) WHERE seat <= 25""")
def interleave_share(spark, d):
    e = G.events(spark, d).withColumn("tier", F.when(F.col("is_risk"), 0).otherwise(1))
    mine = F.substring("company", 2, 20).cast("int") < 40
    return ranking.interleave(e, ["event_type"], "tier", mine, [F.col("occurred_at").desc(), F.col("event_id")], 25).select("event_type", "event_id", "seat")


@query("SELECT company, event_id, event_type, CAST(seat AS INT) AS seat FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY turn, event_type) AS seat FROM (SELECT *, row_number() OVER (PARTITION BY company, event_type ORDER BY occurred_at DESC, event_id) AS turn FROM ev)) WHERE seat <= 12")
def round_robin(spark, d):
    return ranking.turns(G.events(spark, d), ["company"], "event_type", [F.col("occurred_at").desc(), F.col("event_id")], 12).select("company", "event_id", "event_type", "seat")


@query("SELECT o_custkey, o_orderkey, CAST(seat AS INT) AS seat FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY turn, q) AS seat FROM (SELECT *, date_trunc('quarter', o_orderdate) AS q, row_number() OVER (PARTITION BY o_custkey, date_trunc('quarter', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey) AS turn FROM orders)) WHERE seat <= 6", with_graph=False)
def period_budget(spark, d):
    o = G.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.date_trunc("quarter", "o_orderdate").alias("q"))
    return ranking.turns(o, ["o_custkey"], "q", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 6).select("o_custkey", "o_orderkey", "seat")


@query("SELECT src, tgt, subtype, CAST(seat AS INT) AS seat FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN k <= 3 THEN 0 ELSE 1 END, corroboration DESC, edge_id) AS seat FROM (SELECT *, row_number() OVER (PARTITION BY src, subtype ORDER BY corroboration DESC, edge_id) AS k FROM supplies)) WHERE seat <= 12")
def cap_per_type(spark, d):
    return ranking.floor_then_cap(G.supplies(spark, d), "src", "subtype", [F.col("corroboration").desc(), F.col("edge_id")], 3, 12).select("src", "tgt", "subtype", "seat")


@query("""SELECT company, event_id FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY occurred_at, event_id) - 1 AS i, count(*) OVER (PARTITION BY company) AS n FROM ev)
WHERE n <= 14 OR list_contains(list_transform(range(14), lambda j: CAST(floor(j * n / 14.0::DOUBLE) AS BIGINT)), i)""")
def thin_timeline(spark, d):
    return ranking.thin(G.events(spark, d), "company", [F.col("occurred_at"), F.col("event_id")], 14).select("company", "event_id")


@query("""/*+with*/ p AS (SELECT s.src, s.tgt, s.src IN :ws AS a, s.tgt IN :ws AS b FROM supplies s) SELECT src, tgt, min(CASE WHEN a AND b THEN 0 WHEN NOT a AND NOT b THEN 3 ELSE 1 END) AS priority FROM p GROUP BY ALL""")
def workspace_priority(spark, d):
    a, b = F.col("src").isin(*WORKSPACE), F.col("tgt").isin(*WORKSPACE)
    return G.supplies(spark, d).groupBy("src", "tgt").agg(F.min(ranking.workspace_priority(a, b, F.lit(True))).alias("priority"))


@query("""SELECT query_id, id, rank, CAST(round(CAST(similarity AS DECIMAL(28,10)), 5) AS DOUBLE) AS similarity FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, s AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) AS INT) AS rank
  FROM embeddings q, embeddings v, LATERAL (SELECT round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS s) WHERE q.vec_id % 50 = 0) WHERE rank <= 10""", with_graph=False)
def vector_topk(spark, d):
    v = G.table(spark, d, "embeddings")
    return retrieval.vector_topk(v, v.where("vec_id % 50 = 0"), 10).withColumn("similarity", E.three(F.col("similarity"), 5))


@query("""SELECT vec_id, label, CAST(round(CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (2 - (2 - 2 * c) / 2) / 2)) AS DECIMAL(28,10)), 6) AS DOUBLE) AS similarity, CAST(round_even(c / 0.05::DOUBLE, 0) AS INT) AS bucket FROM (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(64), lambda i: 1.0::DOUBLE)), 9) AS c FROM embeddings)""", with_graph=False)
def vector_similarity(spark, d):
    ones = F.array_repeat(F.lit(1.0), 64)
    e = G.table(spark, d, "embeddings").withColumn("c", F.round(V.cosine(F.col("embedding"), ones), 9))
    return e.select("vec_id", "label", E.three(V.distance_to_similarity(2 - 2 * F.col("c")), 6).alias("similarity"), V.bucket(F.col("c")).alias("bucket"))


_GRAMS = "(SELECT {c}, list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM (SELECT DISTINCT {c} FROM {t}))"
_SPOILT = "substr(p_name, 1, 2) || substr(p_name, 4) || 'x'"
_CANDS = f"cands(candidate) AS (SELECT {_SPOILT} FROM part WHERE p_partkey % 50 = 0 UNION SELECT 'zzz')"
_SIM = f"/*+with*/ {_CANDS}, names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT n_name FROM nation), a AS {_GRAMS.format(c='candidate', t='cands')}, b AS {_GRAMS.format(c='name', t='names')}, sim AS (SELECT candidate, name, len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE) AS similarity FROM a, b)"


def _names(spark, d):
    return G.table(spark, d, "part").select(F.col("p_name").alias("name")).unionByName(G.table(spark, d, "nation").select(F.col("n_name").alias("name"))).distinct()


def _cands(spark, d):
    """The names of all parts whose key is divisible by 50, with a letter lost and one added."""
    return G.table(spark, d, "part").where("p_partkey % 50 = 0").selectExpr(f"{_SPOILT} AS candidate").unionByName(spark.range(1).selectExpr("'zzz' AS candidate"))


@query(_SIM + f" SELECT candidate, name, {r('similarity', 6)} AS similarity FROM sim WHERE similarity >= 0.3")
def trigram_match(spark, d):
    return retrieval.trigram_matches(_cands(spark, d), _names(spark, d)).withColumn("similarity", E.three(F.col("similarity"), 6))


@query(_SIM + f" SELECT candidate, name, {r('similarity', 6)} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY similarity DESC, length(name) DESC, name) AS r FROM sim WHERE similarity >= 0.3) WHERE r = 1")
def trigram_best(spark, d):
    return retrieval.best_match(retrieval.trigram_matches(_cands(spark, d), _names(spark, d))).withColumn("similarity", E.three(F.col("similarity"), 6))


@query("SELECT key, name, CASE WHEN lower(name) = 'customer#000000012' THEN 0 WHEN starts_with(lower(name), 'customer#000000012') THEN 1 ELSE 2 END AS tier FROM nodes WHERE contains(lower(name), 'customer#000000012') ORDER BY tier, length(name), name, key LIMIT 20")
def search_tiers(spark, d):
    return retrieval.search_tiers(G.nodes(spark, d), "Customer#000000012", 20).select("key", "name", "tier")


@query("SELECT key, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS compact FROM nodes WHERE label = 'Product'")
def compact_keys(spark, d):
    n = G.nodes(spark, d).where("label = 'Product'")
    return n.select("key", T.compact(F.col("name")).alias("compact"))


@query("/*+with*/ m AS (SELECT company, event_type, event_id, CAST(substr(occurred_at, 1, 4) AS INT) * 12 + CAST(substr(occurred_at, 6, 2) AS INT) AS m FROM ev), c AS (SELECT *, sum(CASE WHEN m - pm <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY company, event_type ORDER BY m, event_id) AS g FROM (SELECT *, lag(m) OVER (PARTITION BY company, event_type ORDER BY m, event_id) AS pm FROM m)) SELECT event_id AS node, min(event_id) OVER (PARTITION BY company, event_type, g) AS component FROM (SELECT *, count(*) OVER (PARTITION BY company, event_type, g) AS n FROM c) WHERE n > 1")
def event_groups(spark, d):
    pairs = resolution.event_runs(G.events(spark, d))
    return resolution.connected(pairs, shared_checkpoint(spark))


@query(None, with_graph=False)
def er_components(spark, d):
    """Suppliers tied by parts of one group; over all lines, so a recursive query is too slow and the test is by brute force."""
    items = G.table(spark, d, "lineitem").select("l_suppkey", F.expr("l_partkey div 3").alias("g")).distinct()
    return resolution.connected(resolution.blocked_pairs(items, ["g"], "l_suppkey"), shared_checkpoint(spark))


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1", with_graph=False)
def latest_per_group(spark, d):
    o = G.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return consolidate.latest_per_group(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@query("""/*+with*/ m AS (SELECT key, name, sector, CASE WHEN starts_with(key, 'S') AND key LIKE '%3' THEN sector END AS code, degree FROM nodes JOIN (SELECT src AS k, count(*) AS degree FROM supplies GROUP BY src) ON key = k WHERE label = 'Company'), g AS (SELECT sector, arg_min(key, struct_pack(a := code IS NULL, b := -degree, c := key)) AS keep FROM m GROUP BY sector HAVING count(*) > 1 AND count(DISTINCT code) <= 1) SELECT m.key AS old, g.keep FROM m JOIN g USING (sector) WHERE m.key <> g.keep""")
def merge_keepers(spark, d):
    deg = G.supplies(spark, d).groupBy(F.col("src").alias("key")).agg(F.count("*").alias("degree"))
    code = F.when(F.col("key").startswith("S") & F.col("key").endswith("3"), F.col("sector"))
    m = G.nodes(spark, d).where("label = 'Company'").join(deg, "key").withColumn("code", code)
    return consolidate.merge_keeper(m, "sector", code="code", degree="degree")


def shared_checkpoint(spark):
    """Cuts lineage in the folder named by spark.checkpoint.dir; a local one is set only where that is unset and all runs on one machine."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(G.shared_folder(spark))
    return lambda df: df.checkpoint()
