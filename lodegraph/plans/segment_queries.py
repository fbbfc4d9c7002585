"""Units of segment revenues over all orders, as the segments of each customer's years."""

from __future__ import annotations

from ..operators import segments
from .record_queries import Rows
from .registry import query

_UNIT = "CASE o_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 10 ELSE 1 END"
SEGMENTS = Rows("orders", ("o_custkey AS corp", "year(o_orderdate) AS year", "'seg' || CAST(o_orderkey % 6 AS STRING) AS name", "CASE WHEN o_orderkey % 19 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS revenue", "CAST(CASE o_orderkey % 6 WHEN 0 THEN 100.0 WHEN 1 THEN 50.0 WHEN 2 THEN 50.2 WHEN 3 THEN 33.3 WHEN 4 THEN 66.9 END AS DOUBLE) AS ratio"))
TOTALS = f"(SELECT corp, year, CAST(sum(amount) AS BIGINT) AS revenue FROM (SELECT o_custkey AS corp, year(o_orderdate) AS year, CAST(floor(o_totalprice) AS BIGINT) * {_UNIT} AS amount FROM orders WHERE o_custkey % 11 > 0) t GROUP BY corp, year)"


@query(
    f"""WITH s AS (SELECT *, coalesce(count(ratio) OVER y >= 3 AND ratio BETWEEN 98 AND 102 AND round(sum(ratio) OVER y - sum(ratio) OVER (PARTITION BY corp, year, name), 6) BETWEEN 95 AND 105, false) AS is_total FROM {SEGMENTS.sql} WINDOW y AS (PARTITION BY corp, year)),
    g AS (SELECT corp, year, sum(revenue) FILTER (NOT is_total) AS seg, round(sum(ratio) FILTER (NOT is_total), 6) AS shares FROM s GROUP BY ALL),
    k AS (SELECT g.*, t.revenue AS total, CAST(seg AS DOUBLE) / t.revenue AS a FROM g LEFT JOIN {TOTALS} t USING (corp, year)),
    p AS (SELECT *, (SELECT arg_min(c, struct_pack(o := abs(a * c - 1), c := c)) FROM (VALUES (1), (1000), (1000000)) v(c) WHERE a * c BETWEEN 0.75 AND 1.35) AS scale FROM k),
    q AS (SELECT *, CASE WHEN coalesce(total, 0) = 0 OR coalesce(seg, 0) = 0 THEN 'no_total' WHEN scale = 1 THEN 'ok' WHEN scale > 1 THEN 'scaled' WHEN shares BETWEEN 95 AND 105 THEN 'rebuilt' ELSE 'unknown' END AS status FROM p)
    SELECT corp, year, name, is_total, status, CAST(CASE WHEN NOT is_total AND status = 'scaled' THEN revenue * scale WHEN NOT is_total AND status = 'rebuilt' AND ratio IS NOT NULL THEN CAST(round(CAST(total AS DECIMAL(24,0)) * CAST(ratio AS DECIMAL(10,4)) / 100, 0) AS BIGINT) ELSE revenue END AS BIGINT) AS revenue, ratio,
        NOT is_total AND status IN ('ok', 'scaled', 'rebuilt') AS revenue_trusted, shares BETWEEN 85 AND 115 AS ratio_trusted FROM s JOIN q USING (corp, year)""",
    with_graph=False,
)
def segment_units(spark, d):
    from ..sources import graph as G

    orders = G.table(spark, d, "orders").where("o_custkey % 11 > 0")
    totals = orders.selectExpr("o_custkey AS corp", "year(o_orderdate) AS year", f"CAST(floor(o_totalprice) AS BIGINT) * {_UNIT} AS amount").groupBy("corp", "year").sum("amount").withColumnRenamed("sum(amount)", "revenue")
    return segments.repaired_units(SEGMENTS.df(spark, d), totals)
