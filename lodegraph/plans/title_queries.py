"""Titles of executives from generated sentences, over all orders; names are patterns, so the test is by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import titles
from .record_queries import Rows
from .registry import query

_PERSON = "CASE {n} % 5 WHEN 0 THEN '김민표' WHEN 1 THEN '박성하' WHEN 2 THEN '오창훈' WHEN 3 THEN '이순' ELSE '최정' END"
_FIRM = "'한빛' || CAST({n} % 23 AS STRING) || '전자'"
_TITLE = "CASE {n} % 9 WHEN 0 THEN '대표이사' WHEN 1 THEN '부회장' WHEN 2 THEN '전무이사' WHEN 3 THEN 'CTO' WHEN 4 THEN '감사위원' WHEN 5 THEN '최고재무책임자' WHEN 6 THEN '사외이사' WHEN 7 THEN '실장' ELSE '본부장' END"
POSTS = Rows("orders", ("CAST(o_orderkey AS STRING) AS edge_id", _PERSON.format(n="o_orderkey") + " AS person", _FIRM.format(n="o_custkey") + " AS company", "CASE o_orderkey % 4 WHEN 0 THEN '임원' WHEN 1 THEN '' WHEN 2 THEN 'OTHER' ELSE '사장' END AS subtype", "CAST(o_orderkey AS STRING) AS e1", "CAST(o_orderkey + 1 AS STRING) AS e2"))
_OWN, _OTHER = _FIRM.format(n="o_custkey"), _FIRM.format(n="(o_custkey + o_orderkey)")
SENTENCES = Rows(
    "orders",
    (
        "CAST(o_orderkey AS STRING) AS evidence_id",
        f"CASE o_orderkey % 7 WHEN 0 THEN {_OWN} || '의 ' WHEN 1 THEN '' ELSE '어제 ' END || {_PERSON.format(n='(o_orderkey + o_orderkey % 3)')} || CASE o_orderkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN ' ' || {_OTHER} || ' ' WHEN 2 THEN ' 전 ' WHEN 3 THEN ' ' || {_OWN} || ' ' WHEN 4 THEN '이 왔다. ' || substr({_PERSON.format(n='o_orderkey')}, 1, 1) || ' ' ELSE ' (주) ' END || {_TITLE.format(n='(o_orderkey * 7 + o_custkey)')} || '은 말했다' AS text",
    ),
)
FIRMS = Rows("customer", (_FIRM.format(n="c_custkey") + " AS name",))


def posts(spark, d):
    return POSTS.df(spark, d).withColumn("evidence_ids", F.array("e1", "e2"))


def sentences(spark, d):
    return SENTENCES.df(spark, d)


def firms(spark, d):
    return FIRMS.df(spark, d).distinct()


@query(None, with_graph=False)
def executive_titles(spark, d):
    return titles.titles_from_evidence(posts(spark, d), sentences(spark, d), firms(spark, d))
