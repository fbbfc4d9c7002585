"""Relations, joins over patterns, propagation, consolidation and insight, on the projected graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edges as E
from ..operators import consolidate, insight, patterns, relations
from ..sources import graph as G
from .registry import EVENT_DAY, TODAY, WORKSPACE, query

ASSESSED = """/*+with*/ a AS (SELECT *, CAST(date_diff('day', CAST(last_seen AS DATE), DATE :today) AS INT) AS age, coalesce(is_current, true) = false AS ended, coalesce(CAST(valid_until AS DATE) < DATE :today, false) AS ran_out FROM supplies),
fresh AS (SELECT *, CASE WHEN ended THEN 'expired' WHEN ran_out THEN 'expired' WHEN last_seen IS NULL THEN 'unknown' WHEN coalesce(refresh_cycle_days, 0) = 0 THEN 'current' WHEN age > refresh_cycle_days * 1.5 THEN 'stale' ELSE 'current' END AS status,
  CASE WHEN ended OR ran_out THEN 0.3::DOUBLE WHEN last_seen IS NULL THEN 0.7 WHEN coalesce(refresh_cycle_days, 0) = 0 THEN 1.0 WHEN age > refresh_cycle_days * 1.5 THEN 0.6 ELSE 1.0 END AS factor,
  CASE WHEN ended THEN NULL WHEN ran_out THEN CAST(date_diff('day', CAST(valid_until AS DATE), DATE :today) AS INT) ELSE age END AS days_since,
  CASE WHEN NOT coalesce(suspect, false) THEN 'supported' ELSE coalesce(stage1, 'unfounded') END AS verdict FROM a),
scored AS (SELECT *, (CASE WHEN coalesce(confidence, 0) = 0 THEN 0.7::DOUBLE ELSE confidence END) * factor * (least(greatest(coalesce(nullif(corroboration, 0), 1) - 1, 0), 4) * 0.05::DOUBLE + 1.0::DOUBLE) * CASE WHEN verdict = 'wrong_type' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM fresh)
"""
R3 = "CAST(round(CAST({} AS DECIMAL(28,10)), {}) AS DOUBLE)"


def r(x: str, n: int = 3) -> str:
    return R3.format(x, n)


@query(ASSESSED + f"SELECT edge_id, src, tgt, subtype, status, verdict, corroboration, {r('score', 6)} AS score FROM scored WHERE verdict NOT IN ('unfounded', 'insufficient') AND status <> 'expired' AND score >= 0.2")
def rel_scored(spark, d):
    out = relations.relations(G.supplies(spark, d), TODAY, min_score=0.2)
    return out.select("edge_id", "src", "tgt", "subtype", "status", "verdict", "corroboration", E.three(F.col("score"), 6).alias("score"))


@query(ASSESSED + f"SELECT edge_id, status, days_since, factor, {r('coalesce(confidence, 1.0) * factor')} AS effective FROM fresh")
def freshness(spark, d):
    return relations.scored(G.supplies(spark, d), TODAY).select("edge_id", "status", "days_since", "factor", E.effective_confidence().alias("effective"))


@query(ASSESSED + f"SELECT edge_id, src, tgt, type, subtype, false AS symmetric, status AS freshness, {r('least(score, 1.0)')} AS score, verdict, days_since, refresh_cycle_days - days_since AS days_until_refresh, 'trade' AS category FROM scored WHERE src <> tgt AND verdict NOT IN ('unfounded', 'insufficient') AND status <> 'expired'")
def relation_rows(spark, d):
    return relations.relation_rows(G.supplies(spark, d), TODAY)


@query(ASSESSED + f"SELECT edge_id, {r('score', 6)} AS score FROM (SELECT *, round(CAST(score AS DECIMAL(28,10)), 6) AS s FROM scored WHERE verdict NOT IN ('unfounded', 'insufficient') AND status <> 'expired') ORDER BY s DESC, edge_id LIMIT 50")
def relation_topk(spark, d):
    e = relations.relations(G.supplies(spark, d), TODAY).select("edge_id", E.three(F.col("score"), 6).alias("score"))
    return e.orderBy(F.col("score").desc(), "edge_id").limit(50)


@query("SELECT key, outgoing, count(*) AS n, count(DISTINCT other) AS others FROM (SELECT src AS key, tgt AS other, true AS outgoing FROM supplies UNION ALL SELECT tgt, src, false FROM supplies WHERE src <> tgt) GROUP BY ALL")
def one_hop(spark, d):
    pairs = G.supplies(spark, d).groupBy("src", "tgt").agg(F.count("*").alias("m"))
    return relations.one_hop(pairs).groupBy("key", "outgoing").agg(F.sum("m").alias("n"), F.count("other").alias("others"))


@query("SELECT key, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS key FROM supplies UNION ALL SELECT tgt FROM supplies WHERE src <> tgt) GROUP BY key")
def degrees(spark, d):
    return relations.degrees(G.supplies(spark, d))


@query("SELECT edge_id, src, tgt FROM supplies WHERE src IN :ws AND tgt IN :ws")
def workspace_direct(spark, d):
    return relations.within(G.supplies(spark, d), WORKSPACE).select("edge_id", "src", "tgt")


@query("SELECT edge_id, CASE WHEN src = 'S1' AND tgt <> 'S1' THEN 'outgoing' WHEN tgt = 'S1' AND src <> 'S1' THEN 'incoming' END AS direction FROM supplies WHERE src IN ('S1', 'S2')")
def relation_direction(spark, d):
    return G.supplies(spark, d).where("src in ('S1', 'S2')").select("edge_id", relations.direction("S1").alias("direction"))


@query("SELECT src AS owner, tgt AS held, type, 'owns' AS side FROM simple_edges WHERE type = 'REGULATES' UNION ALL SELECT tgt, src, type, 'owned_by' FROM simple_edges WHERE type = 'REGULATES'")
def ownership_both_ways(spark, d):
    e = G.simple_edges(spark, d).where("type = 'REGULATES'")
    owns = e.select(F.col("src").alias("owner"), F.col("tgt").alias("held"), "type", F.lit("owns").alias("side"))
    return owns.unionByName(e.select(F.col("tgt").alias("owner"), F.col("src").alias("held"), "type", F.lit("owned_by").alias("side")))


@query("SELECT src, tgt, name FROM (SELECT src, tgt, name, row_number() OVER (PARTITION BY src ORDER BY name, tgt) AS r FROM simple_edges JOIN nodes ON tgt = key WHERE type = 'DEVELOPS') WHERE r <= 10")
def products_of(spark, d):
    e = G.simple_edges(spark, d).where("type = 'DEVELOPS'").join(G.nodes(spark, d).select("key", "name"), F.col("tgt") == F.col("key"))
    return relations.top_per_key(e, ["src"], [F.col("name"), F.col("tgt")], 10).select("src", "tgt", "name")


_SHARED = "SELECT m.src AS anchor, p.src AS peer, count(DISTINCT m.tgt) AS n FROM (SELECT DISTINCT src, tgt FROM supplies WHERE src IN :ws) m JOIN (SELECT DISTINCT src, tgt FROM supplies) p ON m.tgt = p.tgt AND m.src <> p.src"


@query(_SHARED + " WHERE p.src IN :ws AND NOT EXISTS (SELECT 1 FROM supplies s WHERE (s.src = m.src AND s.tgt = p.src) OR (s.src = p.src AND s.tgt = m.src)) GROUP BY ALL")
def shared_customers(spark, d):
    return patterns.shared_targets(G.supplies(spark, d), WORKSPACE, WORKSPACE).select("anchor", "peer", "n")


@query("/*+with*/ p AS (" + _SHARED + " GROUP BY ALL), deg AS (SELECT key, count(*) AS degree FROM (SELECT src AS key FROM supplies UNION ALL SELECT tgt FROM supplies) GROUP BY key) SELECT peer, CAST(sum(n) AS BIGINT) AS n, degree FROM p JOIN deg ON peer = key WHERE peer NOT IN :ws GROUP BY peer, degree")
def suggest_peers(spark, d):
    e = G.supplies(spark, d)
    found = patterns.shared_targets(e, WORKSPACE, unlinked=False).where(~F.col("peer").isin(*WORKSPACE)).groupBy("peer").agg(F.sum("n").alias("n"))
    return found.join(relations.degrees(e).withColumnRenamed("key", "peer"), "peer").select("peer", "n", "degree")


_USE = "use_ AS (SELECT src, tgt FROM supplies WHERE NOT coalesce(suspect, false) AND coalesce(is_current, true)), hop AS (SELECT DISTINCT * FROM (SELECT src AS key, tgt AS other FROM use_ UNION ALL SELECT tgt, src FROM use_)), deg AS (SELECT key, count(*) AS degree FROM (SELECT src AS key FROM supplies UNION ALL SELECT tgt FROM supplies WHERE src <> tgt) GROUP BY key)"


@query(f"/*+with*/ {_USE}, reach AS (SELECT a.key AS island, a.other AS mid, count(DISTINCT b.key) AS reach FROM hop a JOIN hop b ON a.other = b.other AND a.key <> b.key WHERE a.key IN ('S1', 'S2', 'S3') AND b.key IN ('S5', 'S6', 'S7', 'S8') AND a.other NOT IN ('S1', 'S2', 'S3', 'S5', 'S6', 'S7', 'S8') GROUP BY ALL) SELECT island, mid, reach, degree FROM (SELECT island, mid, reach, degree, row_number() OVER (PARTITION BY island ORDER BY reach DESC, degree, mid) AS r FROM reach JOIN deg ON mid = key WHERE degree <= 150) WHERE r <= 3")
def workspace_bridges(spark, d):
    return patterns.bridges(G.supplies(spark, d), ("S1", "S2", "S3"), ("S5", "S6", "S7", "S8")).select("island", "mid", "reach", "degree")


@query("/*+with*/ e AS (SELECT src, tgt FROM supplies UNION ALL SELECT src, tgt FROM simple_edges WHERE type = 'DEPENDS_ON'), deg AS (SELECT key, count(*) AS degree FROM (SELECT src AS key FROM e UNION ALL SELECT tgt FROM e) GROUP BY key), hits AS (SELECT tgt AS mid, count(DISTINCT src) AS hits FROM supplies WHERE src IN :ws AND tgt NOT IN :ws GROUP BY tgt), dst AS (SELECT src AS mid, count(DISTINCT tgt) AS n_dst FROM simple_edges WHERE type = 'DEPENDS_ON' AND src NOT IN :ws AND tgt NOT IN :ws GROUP BY src) SELECT hits.mid, hits, n_dst, degree FROM hits JOIN dst USING (mid) JOIN deg ON mid = key WHERE hits >= 2 AND degree <= 60")
def bottlenecks(spark, d):
    depends = G.simple_edges(spark, d).where("type = 'DEPENDS_ON'")
    return patterns.bottlenecks(G.supplies(spark, d).select("src", "tgt"), depends.select("src", "tgt"), WORKSPACE)


@query("SELECT * FROM (SELECT other AS ref, count(DISTINCT me) AS members, count(*) AS edges FROM (SELECT src AS me, tgt AS other FROM supplies WHERE src IN :ws UNION ALL SELECT tgt, src FROM supplies WHERE tgt IN :ws) WHERE other NOT IN :ws GROUP BY other) ORDER BY members DESC, edges DESC, ref LIMIT 30")
def workspace_refs(spark, d):
    hop = relations.one_hop(G.supplies(spark, d)).where(F.col("key").isin(*WORKSPACE) & ~F.col("other").isin(*WORKSPACE))
    refs = hop.groupBy(F.col("other").alias("ref")).agg(F.count_distinct("key").alias("members"), F.count("*").alias("edges"))
    return refs.orderBy(F.col("members").desc(), F.col("edges").desc(), "ref").limit(30)


@query("SELECT company AS ref, count(*) AS weight, count(DISTINCT event_type) AS kinds FROM ev WHERE is_risk AND company NOT IN :ws GROUP BY company")
def workspace_risk_refs(spark, d):
    e = G.events(spark, d).where(F.col("is_risk") & ~F.col("company").isin(*WORKSPACE))
    return e.groupBy(F.col("company").alias("ref")).agg(F.count("*").alias("weight"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT edge_id FROM supplies WHERE (src IN ('S1', 'S2') AND tgt IN ('C1', 'C2', 'C4')) OR (src IN ('C1', 'C2', 'C4') AND tgt IN ('S1', 'S2'))")
def workspace_ref_edges(spark, d):
    e, refs, pinned = G.supplies(spark, d), ["S1", "S2"], ["C1", "C2", "C4"]
    return e.where((F.col("src").isin(refs) & F.col("tgt").isin(pinned)) | (F.col("src").isin(pinned) & F.col("tgt").isin(refs))).select("edge_id")


@query("SELECT i.event_id, i.origin, i.occurred_at, i.target, coalesce(i.sign, '') AS sign FROM impacts i WHERE i.target IN :ws AND i.origin NOT IN :ws AND i.is_risk AND i.occurred_at >= '2024-01-15'")
def inbound_risk(spark, d):
    i = G.impacts(spark, d).where(F.col("target").isin(*WORKSPACE) & ~F.col("origin").isin(*WORKSPACE) & F.col("is_risk") & (F.col("occurred_at") >= "2024-01-15"))
    return i.select("event_id", "origin", "occurred_at", "target", F.coalesce("sign", F.lit("")).alias("sign"))


@query("SELECT company, event_id, event_type, occurred_at, is_risk, sign FROM (SELECT ev.*, i.sign, row_number() OVER (PARTITION BY ev.company ORDER BY ev.is_risk DESC, ev.occurred_at DESC, ev.event_id) AS r FROM ev LEFT JOIN (SELECT event_id, min(sign) AS sign FROM impacts GROUP BY event_id) i USING (event_id)) WHERE r <= 10")
def events_of(spark, d):
    e = G.events(spark, d)
    sign = G.impacts(spark, d).groupBy("event_id").agg(F.min("sign").alias("sign"))
    joined = e.join(sign, "event_id", "left")
    return relations.top_per_key(joined, ["company"], [F.col("is_risk").desc(), F.col("occurred_at").desc(), F.col("event_id")], 10).select("company", "event_id", "event_type", "occurred_at", "is_risk", "sign")


@query("/*+with*/ pairs(pos, company, event_id) AS (VALUES (0, 'C1', 'E1'), (1, 'C2', 'E7'), (2, 'C9', 'E2')) SELECT CAST(p.pos AS INT) AS pos, p.company, p.event_id, e.event_type FROM pairs p LEFT JOIN ev e ON e.event_id = p.event_id AND e.company = p.company")
def events_by_pairs(spark, d):
    pairs = spark.createDataFrame([(0, "C1", "E1"), (1, "C2", "E7"), (2, "C9", "E2")], "pos int, company string, event_id string")
    return pairs.join(G.events(spark, d).select("company", "event_id", "event_type"), ["company", "event_id"], "left").select("pos", "company", "event_id", "event_type")


_PROPAGATE = ASSESSED + """, seen AS (SELECT * FROM fresh WHERE NOT coalesce(suspect, false) OR coalesce(stage1 = 'wrong_type', false)),
legs AS (SELECT src AS company, tgt AS other, factor, coalesce(is_current, true) AS live, 'supply' AS channel, 0.55::DOUBLE AS decay FROM seen UNION ALL SELECT tgt, src, factor, coalesce(is_current, true), 'demand', 0.35::DOUBLE FROM seen),
fan AS (SELECT company, channel, count(*) AS fan FROM legs GROUP BY ALL),
direct AS (SELECT event_id, target AS company, (CASE WHEN coalesce(confidence, 0) = 0 THEN 0.7::DOUBLE ELSE confidence END) * 0.7::DOUBLE AS s1 FROM impacts),
hops AS (SELECT event_id, company, 1 AS hops, s1 AS score, '' AS channel FROM direct UNION ALL
  SELECT event_id, l.other, 2, s1 * (l.decay * l.factor * (40.0::DOUBLE / (40.0::DOUBLE + greatest(fan - 1, 0)))), l.channel FROM direct JOIN legs l USING (company) JOIN fan f ON f.company = l.company AND f.channel = l.channel WHERE l.live),
rounded AS (SELECT event_id, company, hops, CAST(round(CAST(score AS DECIMAL(28,10)), 6) AS DOUBLE) AS score, channel FROM hops)
SELECT event_id, company, hops, score, channel FROM (SELECT *, row_number() OVER (PARTITION BY event_id, company ORDER BY score DESC, hops, channel DESC) AS r FROM rounded WHERE score >= 0.05) WHERE r = 1"""


@query(_PROPAGATE)
def propagate(spark, d):
    return patterns.propagate(G.impacts(spark, d), G.supplies(spark, d), TODAY, tasks=G.line_tasks(spark, d))


@query("""/*+with*/ lines AS (SELECT 'S' || l_suppkey AS src, 'C' || o_custkey AS tgt, l_returnflag AS subtype, l_orderkey * 10 + l_linenumber AS line, (10 - CAST(round(l_discount * 100) AS INT)) / 10 AS confidence, strftime(l_shipdate, '%Y-%m-%d') AS last_seen, 'order-' || l_orderkey AS doc FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT src, tgt, subtype, count(*) AS n, count(DISTINCT doc) AS corroboration, max(last_seen) AS last_seen, arg_max(line, struct_pack(a := confidence, b := last_seen, c := -line)) AS survivor FROM lines GROUP BY ALL""")
def edge_dedup(spark, d):
    out = consolidate.dedup_edges(consolidate.line_edges(G.supply_lines(spark, d)), ["src", "tgt", "subtype"], "line")
    return out.select("src", "tgt", "subtype", "n", F.size("source_docs").cast("long").alias("corroboration"), "last_seen", F.col("survivor.line").alias("survivor"))


@query("""/*+with*/ subs AS (SELECT src, tgt, subtype, count(*) AS n FROM (SELECT 'S' || l_suppkey AS src, 'C' || o_custkey AS tgt, CASE WHEN l_linenumber = 1 THEN 'SUPPLIES_TO' WHEN l_linenumber = 2 THEN l_returnflag || ' 12.5%' ELSE l_returnflag END AS subtype FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ALL),
k AS (SELECT *, subtype <> 'SUPPLIES_TO' AS named, NOT regexp_matches(subtype, '[0-9]+([.][0-9]+)? *%') AS plain FROM subs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY plain DESC, n DESC, length(subtype) DESC, subtype) AS r FROM k WHERE named)
SELECT s.src, s.tgt, coalesce(r.subtype, '') AS subtype, CAST(sum(s.n) AS BIGINT) AS n, count(*) AS n_subtypes FROM subs s LEFT JOIN ranked r ON r.src = s.src AND r.tgt = s.tgt AND r.r = 1 GROUP BY s.src, s.tgt, r.subtype""")
def edge_cluster(spark, d):
    e = G.supply_lines(spark, d).select(G.key("S", "l_suppkey").alias("src"), G.key("C", "o_custkey").alias("tgt"), F.when(F.col("l_linenumber") == 1, "SUPPLIES_TO").when(F.col("l_linenumber") == 2, F.concat("l_returnflag", F.lit(" 12.5%"))).otherwise(F.col("l_returnflag")).alias("subtype"))
    return consolidate.cluster_subtypes(e, ["src", "tgt"], type_name="SUPPLIES_TO")


@query("SELECT tgt, count(DISTINCT src) AS k FROM supplies WHERE NOT coalesce(suspect, false) GROUP BY tgt")
def base_rates(spark, d):
    return insight.base_rates(G.supplies(spark, d))


@query("""/*+with*/ liv AS (SELECT * FROM supplies WHERE NOT coalesce(suspect, false) AND coalesce(is_current, true) AND (valid_until IS NULL OR valid_until >= :today)),
base AS (SELECT tgt, count(DISTINCT src) AS base FROM supplies WHERE NOT coalesce(suspect, false) GROUP BY tgt), total AS (SELECT count(*) AS total FROM nodes WHERE label = 'Company'), mine AS (SELECT count(DISTINCT src) AS of_ FROM liv WHERE src IN :ws),
hits AS (SELECT tgt, count(DISTINCT src) AS hits FROM liv WHERE src IN :ws GROUP BY tgt)
SELECT tgt AS subject, hits, base, CAST(round(CAST((CAST(hits AS DOUBLE) / of_) / (CAST(base AS DOUBLE) / total) AS DECIMAL(28,10)), 1) AS DOUBLE) AS lift,
CASE WHEN (CAST(hits AS DOUBLE) / of_) / (CAST(base AS DOUBLE) / total) >= 100 THEN 'extraordinary' WHEN (CAST(hits AS DOUBLE) / of_) / (CAST(base AS DOUBLE) / total) >= 30 THEN 'unusual' ELSE 'concentrated' END AS label
FROM hits JOIN base USING (tgt), total, mine WHERE hits >= 2 AND (CAST(hits AS DOUBLE) / of_) / (CAST(base AS DOUBLE) / total) >= 10""")
def lift_concentration(spark, d):
    n = G.nodes(spark, d).where("label = 'Company'")
    return insight.concentration(G.supplies(spark, d), n, WORKSPACE, TODAY)


@query("/*+with*/ c AS (SELECT tgt, sector, count(*) AS n, sum(count(*)) OVER (PARTITION BY tgt) AS total FROM (SELECT DISTINCT src, tgt FROM supplies) JOIN nodes ON src = key GROUP BY tgt, sector) SELECT tgt, sector, n, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY tgt ORDER BY n DESC, sector) AS r FROM c) WHERE r = 1 AND n >= 2 AND n * 100 >= 20 * total")
def sector_mode(spark, d):
    pairs = G.supplies(spark, d).select("src", "tgt").distinct().join(G.nodes(spark, d).select(F.col("key").alias("src"), "sector"), "src")
    return insight.sector_mode(pairs, least_percent=20)


@query("SELECT key, max(last_seen) AS last_seen, min(first_seen) AS first_seen FROM (SELECT src AS key, last_seen, first_seen FROM supplies UNION ALL SELECT tgt, last_seen, first_seen FROM supplies) GROUP BY key")
def node_seen(spark, d):
    return relations.one_hop(G.supplies(spark, d)).groupBy("key").agg(F.max("last_seen").alias("last_seen"), F.min("first_seen").alias("first_seen"))


@query("SELECT src, tgt, list_sort(list_distinct(list(source_doc)))[1] AS first_doc, count(DISTINCT source_doc) AS n_docs, count(DISTINCT source_type) AS n_types, CASE WHEN count(DISTINCT source_type) = 1 THEN min(source_type) END AS consensus FROM supplies GROUP BY src, tgt")
def source_consensus(spark, d):
    # a pair has an edge per return flag, so its sets are small
    size = lambda c: F.size(F.collect_set(c)).cast("long")
    g = G.supplies(spark, d).groupBy("src", "tgt").agg(F.min("source_doc").alias("first_doc"), size("source_doc").alias("n_docs"), size("source_type").alias("n_types"), F.min("source_type").alias("t"))
    return g.select("src", "tgt", "first_doc", "n_docs", "n_types", F.when(F.col("n_types") == 1, F.col("t")).alias("consensus"))


@query("SELECT src AS member, CAST(count(*) FILTER (suspect) AS BIGINT) AS suspects, CAST(count(*) AS BIGINT) AS edges, CAST(count(*) FILTER (valid_until >= :today AND valid_until <= '2001-12-31') AS BIGINT) AS expiring, CAST(count(*) FILTER (first_seen >= '2001-01-01') AS BIGINT) AS new_edges FROM supplies WHERE src IN :ws GROUP BY src")
def workspace_changes(spark, d):
    e = G.supplies(spark, d).where(F.col("src").isin(*WORKSPACE))
    return e.groupBy(F.col("src").alias("member")).agg(F.count_if("suspect").alias("suspects"), F.count("*").alias("edges"), F.count_if((F.col("valid_until") >= TODAY) & (F.col("valid_until") <= "2001-12-31")).alias("expiring"), F.count_if(F.col("first_seen") >= "2001-01-01").alias("new_edges"))


@query("SELECT src, tgt, edge_id, last_seen FROM (SELECT *, max(last_seen) OVER (PARTITION BY src) AS newest FROM supplies) WHERE CAST(last_seen AS DATE) < CAST(newest AS DATE) - INTERVAL 1000 DAY")
def stale_loads(spark, d):
    return insight.missing_from_newest_load(G.supplies(spark, d), days=1000).select("src", "tgt", "edge_id", "last_seen")


@query("/*+with*/ r AS (SELECT company, event_id, CAST(row_number() OVER (PARTITION BY company ORDER BY occurred_at DESC, event_id) AS INT) AS r FROM ev WHERE is_risk) SELECT r.company, r.event_id, r.r, count(s.edge_id) AS live_edges FROM r LEFT JOIN supplies s ON s.tgt = r.company AND NOT coalesce(s.suspect, false) WHERE r <= 3 GROUP BY ALL")
def latest_risk_events(spark, d):
    e = G.events(spark, d).where("is_risk")
    from pyspark.sql.window import Window as W

    r3 = e.withColumn("r", F.row_number().over(W.partitionBy("company").orderBy(F.col("occurred_at").desc(), "event_id"))).where("r <= 3").select("company", "event_id", "r")
    n = G.supplies(spark, d).where(~F.coalesce("suspect", F.lit(False))).groupBy(F.col("tgt").alias("company")).agg(F.count("*").alias("n"))
    return r3.join(n, "company", "left").select("company", "event_id", "r", F.coalesce("n", F.lit(0)).alias("live_edges"))


@query(f"SELECT company, event_type, count(*) AS n, max(occurred_at) AS latest, CAST(date_diff('day', CAST(max(occurred_at) AS DATE), DATE '{EVENT_DAY}') AS INT) AS silent_days FROM ev GROUP BY ALL")
def event_recency(spark, d):
    g = G.events(spark, d).groupBy("company", "event_type").agg(F.count("*").alias("n"), F.max("occurred_at").alias("latest"))
    return g.withColumn("silent_days", F.datediff(F.lit(EVENT_DAY).cast("date"), F.col("latest").cast("date")))
