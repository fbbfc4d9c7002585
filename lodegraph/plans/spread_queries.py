"""Propagation with units and their firms, and lines shared among events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import propagation
from ..sources import graph as G
from ..sources import scratch
from .graph_queries import ASSESSED
from .registry import TODAY, query

_UNITS = "CAST(substr(target, 2) AS INT) % 5 = 2"
_SPREAD = ASSESSED + f""", seen AS (SELECT * FROM fresh WHERE NOT coalesce(suspect, false) OR coalesce(stage1 = 'wrong_type', false)),
legs AS (SELECT src AS company, tgt AS other, factor, coalesce(is_current, true) AS live, 'supply' AS channel, 0.55::DOUBLE AS decay FROM seen UNION ALL SELECT tgt, src, factor, coalesce(is_current, true), 'demand', 0.35::DOUBLE FROM seen),
fan AS (SELECT company, channel, count(*) AS fan FROM legs GROUP BY ALL),
direct AS (SELECT event_id, CASE WHEN {_UNITS} THEN 'S' || (CAST(substr(target, 2) AS INT) - 1) ELSE target END AS company, (CASE WHEN coalesce(confidence, 0) = 0 THEN 0.7::DOUBLE ELSE confidence END) * 0.7::DOUBLE AS s1, CASE WHEN {_UNITS} THEN 'plant' ELSE '' END AS unit FROM impacts),
hops AS (SELECT event_id, company, 1 AS hops, s1 AS score, '' AS channel, company || ':' || unit AS path FROM direct UNION ALL
  SELECT event_id, l.other, 2, s1 * (l.decay * (l.factor * (40.0::DOUBLE / (40.0::DOUBLE + greatest(fan - 1, 0))))), l.channel, d.company || ':' || unit || '>' || l.other || ':' || l.channel FROM direct d JOIN legs l USING (company) JOIN fan f ON f.company = l.company AND f.channel = l.channel WHERE l.live),
rounded AS (SELECT event_id, company, hops, CAST(round(CAST(score AS DECIMAL(28,10)), 6) AS DOUBLE) AS score, channel, path FROM hops),
spread AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, company ORDER BY score DESC, hops, channel DESC, path) AS r FROM rounded WHERE score >= 0.05) WHERE r = 1)
"""


def _spread(spark, d):
    impacts = G.impacts(spark, d)
    units = impacts.select(F.col("target").alias("key")).distinct().where("CAST(substr(key, 2) AS INT) % 5 = 2")
    units = units.select("key", F.concat(F.lit("S"), (F.substring("key", 2, 20).cast("int") - 1).cast("string")).alias("parent"), F.lit("plant").alias("unit"))
    found = propagation.spread(propagation.lifted(impacts, units), G.supplies(spark, d), TODAY, scratch.written, tasks=G.line_tasks(spark, d))
    return found.withColumn("path", F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["company"], p["channel"])), ">"))


@query(f"{_SPREAD} SELECT event_id, company, hops, score, hops = 1 AS stated, channel, path FROM spread")
def propagate_units(spark, d):
    return _spread(spark, d)


_ANSWERS = "lines AS (SELECT CAST(substr(event_id, 2) AS INT) // 5 AS answer_id, event_id, row_number() OVER (PARTITION BY CAST(substr(event_id, 2) AS INT) // 5 ORDER BY company, event_id) AS pos, hops = 1 AS stated, company FROM spread)"


@query(f"{_SPREAD}, {_ANSWERS}, n AS (SELECT *, min(pos) OVER (PARTITION BY answer_id, event_id) AS f, row_number() OVER (PARTITION BY answer_id, event_id ORDER BY NOT stated, pos) AS k FROM lines) SELECT answer_id, event_id, company FROM n QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY k, f) <= 15")
def propagation_lines(spark, d):
    """Fifteen lines an answer; five events make one answer's material."""
    from pyspark.sql.window import Window as W

    answer = F.floor(F.substring("event_id", 2, 20).cast("int") / 5)
    rows = G.over(_spread(spark, d).select("event_id", "company", "stated").withColumn("answer_id", answer), G.line_tasks(spark, d), "answer_id")
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("answer_id").orderBy("company", "event_id")))
    kept, _ = propagation.fair_lines(rows, 15)
    return kept.select("answer_id", "event_id", "company")
