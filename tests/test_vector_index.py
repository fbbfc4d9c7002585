"""Search through cells: exact mode against all pairs, recall of the index, conditions, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from lodegraph.functions.conditions import condition
from lodegraph.operators import vector_index as vi
from lodegraph.plans import catalogue
from pyspark.sql import functions as F


def nearest(x, q, ids, k=10):
    u = lambda a: np.divide(a, np.linalg.norm(a, axis=1, keepdims=True), out=np.zeros_like(a), where=np.linalg.norm(a, axis=1, keepdims=True) > 0)
    s = np.round(u(q) @ u(x).T, 9)
    return [[int(ids[j]) for j in np.lexsort((ids, -row))[:k]] for row in s]


def of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_recall_and_exact_mode_with_clusters(spark, monkeypatch):
    monkeypatch.setattr(vi, "PACK", 100)
    monkeypatch.setattr(vi, "QUERY_PACK", 7)
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16))
    x = (centres[r.integers(0, 40, 3000)] + 0.3 * r.normal(size=(3000, 16))).astype(np.float32).astype(np.float64)
    v = spark.createDataFrame([(i, [float(a) for a in row], i % 4) for i, row in enumerate(x)], "vec_id long, embedding array<float>, part int")
    cells = vi.fit(v)
    indexed, asked = vi.index(v, cells), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert indexed.count() == 3000 and cells.probes <= len(cells.centroids) // 2
    want = dict(zip(range(0, 3000, 50), nearest(x, x[::50], np.arange(3000)), strict=True))
    got = of(vi.search(indexed, asked, cells, 10))
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)
    assert of(vi.search(indexed, asked, cells, 10, exact=True)) == want
    part = np.arange(3000) % 4 == 3
    assert of(vi.search(indexed, asked, cells, 10, where={"part": 3}, exact=True)) == dict(zip(range(0, 3000, 50), nearest(x[part], x[::50], np.arange(3000)[part]), strict=True))


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    x, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows])
    got = of(catalogue.queries()["vector_index_topk"](spark, sf))
    want = dict(zip(ids[ids % 50 == 0].tolist(), nearest(x, x[ids % 50 == 0], ids), strict=True))
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells = vi.fit(v)
    indexed = vi.index(v, cells)
    assert sorted(r.vec_id for r in indexed.collect()) == [1, 5, 6, 6]
    asked = v.where("vec_id in (1, 2)").select(F.col("vec_id").alias("query_id"), "embedding")
    assert of(vi.search(indexed, asked, cells, 3, exact=True)) == {1: [1, 6, 6]}
    none = v.limit(0)
    assert vi.search(vi.index(none, vi.fit(none)), asked, vi.fit(none), 3).count() == 0


TREES = [
    (None, {1, 2, 3, 4}), ({"a": 1}, {1, 2}), ({"a": {"$in": [1, 5]}}, {1, 2}), ({"a": {"$nin": [1]}}, {3}), ({"a": {"$in": []}}, set()), ({"a": {"$nin": []}}, {1, 2, 3}), ({"a": None}, set()),
    ({"$and": [{"a": 1}, {"b": "x"}]}, {1}), ({"$or": [{"a": 2}, {"b": "y"}]}, {2, 3}), ({"a": 1, "b": {"$ne": "x"}}, {2}), ({"a": {"$gt": 0, "$lt": 2}}, {1, 2}), ({"$or": [{"$and": [{"a": 2}, {"b": "z"}]}, {"b": {"$in": ["x"]}}]}, {1, 3}), ({"a": {"$gte": 2}}, {3}), ({"a": {"$lte": 1}}, {1, 2}), ({"b": {"$eq": "x"}}, {1}),
]


@pytest.mark.parametrize(("tree", "ids"), TREES)
def test_condition(spark, tree, ids):
    df = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, "z"), (4, None, None)], "id int, a int, b string")
    assert {r.id for r in df.where(condition(tree)).collect()} == ids


@pytest.mark.parametrize("tree", [{"$not": []}, {"a": {"$like": 1}}, {"$and": []}, {"a": {}}])
def test_condition_that_is_none(spark, tree):
    with pytest.raises(ValueError):
        condition(tree)


def test_condition_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(path)
    plan = spark.read.parquet(path).where(condition({"$and": [{"a": {"$in": [1, 2]}}, {"$or": [{"b": "x"}, {"a": 7}]}]}))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(a, [1,2])" in plan.replace("IsNotNull(a), ", "") or "In(a, [1,2])" in plan
