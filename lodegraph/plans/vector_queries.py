"""Vectors under conditions: exactly, with SQL, and through the index, whose recall a test measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edges as E
from ..operators import vector_index
from ..sources import graph as G
from ..sources import scratch
from .registry import query

#: What is asked for: rows of some labels that lie in either half by their id, as firms at either end of an edge.
WHERE = {"$and": [{"label": {"$in": [1, 3, 4, 8]}}, {"$or": [{"half": "a"}, {"third": {"$gte": 1}}]}]}


def _indexed(spark, d):
    v = G.table(spark, d, "embeddings").selectExpr("vec_id", "embedding", "label", "CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS half", "CASE WHEN vec_id % 5 > 0 THEN CAST(vec_id % 3 AS INT) END AS third")
    cells = vector_index.fit(v)
    return v, cells, scratch.written(vector_index.index(v, cells).repartition("cell"))


def _asked(v):
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_SQL = """SELECT query_id, id, rank, CAST(round(CAST(similarity AS DECIMAL(28,10)), 5) AS DOUBLE) AS similarity FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, s AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) AS INT) AS rank
  FROM embeddings q, embeddings v, LATERAL (SELECT round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS s)
  WHERE q.vec_id % 50 = 0 AND v.label IN (1, 3, 4, 8) AND (v.vec_id % 2 = 0 OR (v.vec_id % 5 > 0 AND v.vec_id % 3 >= 1))) WHERE rank <= 10"""


@query(_SQL, with_graph=False)
def vector_filtered(spark, d):
    v, cells, indexed = _indexed(spark, d)
    return vector_index.search(indexed, _asked(v), cells, 10, where=WHERE, exact=True).withColumn("similarity", E.three(F.col("similarity"), 5))


@query(None, with_graph=False)
def vector_index_topk(spark, d):
    """Through the index: every row is indexed, a fiftieth is asked for, recall is held to 0.9 by a test."""
    v, cells, indexed = _indexed(spark, d)
    return vector_index.search(indexed, _asked(v), cells, 10)
