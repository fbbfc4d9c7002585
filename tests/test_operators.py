from __future__ import annotations

import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.operators import articles, ranking, relations, resolution, retrieval
from lodegraph.sources import graph as G


def keep(df):
    return df.checkpoint()


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(60)] + [(300, 301), (301, 300)]
    got = {r.node: r.component for r in resolution.connected(spark.createDataFrame(edges, "a long, b long"), keep).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(61)}, 300: 300, 301: 300}


def test_one_hop_counts_a_loop_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], "src string, tgt string")
    assert sorted((r.key, r.other, r.outgoing) for r in relations.one_hop(edges).collect()) == [("a", "a", True), ("a", "b", True), ("a", "c", False), ("b", "a", False), ("c", "a", True)]
    assert {r.key: r.degree for r in relations.degrees(edges).collect()} == {"a": 3, "b": 1, "c": 1}


def test_rank_fusion(spark):
    hits = spark.createDataFrame([("q", "v", "x", 0.9, 1), ("q", "v", "y", 0.5, 2), ("q", "v", "x", 0.2, 3), ("q", "t", "y", 0.7, 1)], "q string, list string, item string, score double, pos int")
    got = {r.item: r.rrf for r in ranking.rrf(ranking.ranked(hits, ["q", "list"], "item", "score", "pos"), ["q"], "item").collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61})


def test_interleave_takes_turns_within_tiers(spark):
    rows = [("k", t, s, i) for t in (0, 1) for s, n in (("a", 3), ("b", 1 + 2 * t)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, tier int, s string, i int")
    got = ranking.interleave(df, ["k"], "tier", F.col("s") == "a", [F.col("i")], 8).orderBy("seat").collect()
    assert [(r.tier, r.s, r.i) for r in got] == [(0, "a", 0), (0, "b", 0), (0, "a", 1), (0, "a", 2), (1, "a", 0), (1, "b", 0), (1, "a", 1), (1, "b", 1)]


def test_turns_and_floor(spark):
    df = spark.createDataFrame([("k", t, i) for t, n in (("x", 4), ("y", 1), ("z", 2)) for i in range(n)], "k string, t string, i int")
    got = ranking.turns(df, ["k"], "t", [F.col("i")], 5).orderBy("seat").collect()
    assert [(r.t, r.i) for r in got] == [("x", 0), ("y", 0), ("z", 0), ("x", 1), ("z", 1)]
    got = ranking.floor_then_cap(df, "k", "t", [F.col("i"), F.col("t")], 1, 4).orderBy("seat").collect()
    assert [(r.t, r.i) for r in got] == [("x", 0), ("y", 0), ("z", 0), ("x", 1)]


@pytest.mark.parametrize(("size", "n"), [(3, 5), (10, 4), (97, 12), (12, 12), (100, 1)])
def test_thin_keeps_even_steps(spark, size, n):
    df = spark.range(size).selectExpr("'k' as k", "id")
    got = sorted(r.id for r in ranking.thin(df, "k", [F.col("id")], n).collect())
    assert got == (list(range(size)) if size <= n else sorted({j * size // n for j in range(n)}))


def test_vector_topk_is_exact(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 16))
    x[7] = x[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for row in retrieval.vector_topk(df, df.where("vec_id % 50 = 0"), 10, block=3).orderBy("rank").collect():
        got[row.query_id].append(row.id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, ids in got.items():
        s = np.round(u @ u[q], 9)
        assert ids == sorted(range(300), key=lambda i: (-s[i], i))[:10]
    assert set(got) == {0, 50, 100, 150, 200, 250}


def test_resolve_exact_before_likeness_and_no_guess_between_equals(spark):
    names = spark.createDataFrame([("1", "Hanbit Electronics Co., Ltd."), ("2", "Sunrise Metals"), ("3", "Sunrise Metal Works"), ("4", "Twin"), ("5", "Twin")], "key string, name string")
    mentions = spark.createDataFrame([("HANBIT ELECTRONICS",), ("Sunrise Metals Grp",), ("twin",), ("nothing alike",), (None,)], "candidate string")
    got = {r.candidate: (r.key, r.method) for r in retrieval.resolve(mentions, names, threshold=0.4).collect()}
    assert got == {"HANBIT ELECTRONICS": ("1", "exact"), "Sunrise Metals Grp": ("2", "fuzzy")}


def test_event_chains(spark):
    rows = [("e1", "A", "t", "2024-01"), ("e2", "A", "t", "2024-03"), ("e3", "A", "t", "2024-05-02"), ("e4", "A", "t", "2024-09"), ("e5", "B", "t", "2024-03"), ("e6", "A", "u", "2024-03")]
    df = spark.createDataFrame(rows, "event_id string, company string, event_type string, occurred_at string")
    assert sorted(tuple(r) for r in resolution.event_pairs(df).collect()) == [("e1", "e2"), ("e2", "e3")]


def test_connected_joins_long_paths_of_any_order(spark):
    ids = [f"E{i}" for i in np.random.default_rng(3).permutation(500)]
    falling = [(1000 + i, 1000 + i - 1) for i in range(300, 0, -1)]
    got = {r.node: r.component for r in resolution.connected(spark.createDataFrame([*zip(ids[:-1], ids[1:], strict=True), ("Z", "Z")], "a string, b string"), keep).collect()}
    assert got == {**dict.fromkeys(ids, min(ids)), "Z": "Z"}
    months = [1000 + i for i in range(100)] + [500 + i for i in range(100)]
    for path in (falling, list(zip(months[:-1], months[1:], strict=True))):
        got = {r.node: r.component for r in resolution.connected(spark.createDataFrame(path, "a long, b long"), keep).collect()}
        assert got == dict.fromkeys({x for p in path for x in p}, min(x for p in path for x in p))


def test_connected_raises_rather_than_return_unfinished(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError, match="not complete"):
        resolution.connected(path, keep, most_rounds=2)


def test_products_of_a_batch_are_not_held_at_once():
    rng = np.random.default_rng(5)
    q, x, own = rng.standard_normal((2048, 8)), rng.integers(-2, 3, (3000, 8)).astype(float), np.arange(3000)[::-1].copy()
    tracemalloc.start()
    ids, s = retrieval.nearest(q, x, own, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2048 * 3000 * 8 * 1.5
    all_ = np.round(q[:50] @ x.T, 9)
    order = np.lexsort((np.broadcast_to(own, all_.shape), -all_), axis=1)[:, :10]
    assert (ids[:50] == own[order]).all() and (s[:50] == np.take_along_axis(all_, order, 1)).all()


def test_tasks_grow_in_number_with_the_lines(spark, monkeypatch):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    assert [G.dealt(df, n, "k").rdd.getNumPartitions() for n in (0, 3_000_000, 36_000_000)] == [1, 12, 144]
    monkeypatch.setattr(G, "ROWS_A_TASK", 1000)
    # neither the edges nor their pairs are shuffled again, and no map over a whole split comes before
    pairs = G.supplies(spark, "/root/testdata/sf0.001").groupBy("src", "tgt").agg(F.sum("corroboration").alias("n"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert plan.rindex("HashAggregate") < plan.index("REPARTITION_BY_NUM")


def test_runs_of_events_are_stars(spark):
    rows = [(f"e{i:02}", "c", "t", f"2024-{1 + i // 3:02}-01") for i in range(30)] + [("x1", "c", "t", "2026-01-01"), ("x2", "c", "t", "2026-03-01"), ("n", "c", "t", None), ("o", "d", "t", "2024-01-01")]
    got = sorted(tuple(r) for r in resolution.event_runs(spark.createDataFrame(rows, "event_id string, company string, event_type string, occurred_at string")).collect())
    assert got == [("e00", f"e{i:02}") for i in range(1, 30)] + [("x1", "x2")]


def test_texts_without_an_address_are_spread(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        wanted = spark.range(400).selectExpr("id AS pos", "'e' || id AS evidence_id")
        texts = spark.range(400).selectExpr("'e' || id AS evidence_id", "CASE WHEN id = 7 THEN 'see https://a/7)' ELSE 'x' END AS text", "CASE WHEN id = 9 THEN 'r9' END AS rcept_no", "0 AS occurred_at")
        press = spark.createDataFrame([("https://a/7", "Daily", "2024-02-02"), (None, "none", None), (" e3", "none", None)], "url string, press string, published_at string")
        titles = spark.createDataFrame([("r9", "title"), (None, "none"), (" e4", "none")], "rcept_no string, title string")
        out = articles.evidence_for(wanted, texts, press, titles)
        assert {(r.pos, r.press, r.source_doc) for r in out.where("press IS NOT NULL").collect()} == {(7, "Daily", "https://a/7"), (9, "title", "r9")}
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 400 and max(tasks) < 200
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
