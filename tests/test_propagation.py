"""Propagation against an enumeration of paths, and lines shared among events against taking turns one by one."""

from __future__ import annotations

import random

import pytest

from lodegraph.operators import propagation
from lodegraph.sources import scratch
from pyspark.sql import functions as F

TODAY = "2024-06-01"
EDGES = "edge_id string, src string, tgt string, type string, subtype string, confidence double, corroboration int, first_seen string, last_seen string, valid_until string, is_current boolean, refresh_cycle_days int, suspect boolean, stage1 string, source_type string, source_doc string"
IMPACTS = "event_id string, target string, confidence double"


def graph(spark, seed):
    rng = random.Random(seed)
    edges = []
    for i in range(60):
        a, b = rng.sample(range(14), 2)
        edges.append((f"e{i}", f"c{a}", f"c{b}", "SUPPLIES_TO", "x", rng.choice([0.6, 0.9]), 1, "2020-01-01", rng.choice(["2024-05-01", "2022-01-01"]), None, rng.choice([True, True, None, False]), 365, rng.random() < 0.1, rng.choice([None, "wrong_type"]), "dart", "d"))
    impacts = [(f"E{rng.randrange(6)}", f"c{rng.randrange(14)}", rng.choice([None, 0.0, 0.4, 1.0])) for _ in range(14)] + [("E9", None, 1.0)]
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(impacts, IMPACTS)


@pytest.mark.parametrize(("seed", "hops"), [(1, 1), (1, 2), (2, 3), (3, 4)])
def test_against_every_path(spark, seed, hops):
    edges, impacts = graph(spark, seed)
    units = spark.createDataFrame([("c1", "c2", "plant"), ("c3", "c2", "lab"), ("c4", None, "none")], "key string, parent string, unit string")
    legs = {}
    for r in propagation.legs(edges, TODAY).collect():
        legs.setdefault(r.company, []).append((r.other, r.channel, r.weight))
    up = {"c1": ("c2", "plant"), "c3": ("c2", "lab")}
    best = {}
    for e, target, confidence in [tuple(r) for r in impacts.collect()]:
        if target is None:
            continue
        firm, unit = up.get(target, (target, ""))
        todo = [(0.7 * (confidence or 0.7), 1, "", [(firm, unit)])]
        while todo:
            score, n, channel, path = todo.pop()
            company = path[-1][0]
            if round(score, 6) >= 0.05:
                rank = {"supply": 0, "demand": 1, "": 2}[channel]
                best[e, company] = min(best.get((e, company), (0.0, 99)), (-round(score, 6), n, rank, path))
            if n < hops:
                todo += [(score * w, n + 1, c, [*path, (other, c)]) for other, c, w in legs.get(company, ())]
    found = propagation.spread(propagation.lifted(impacts, units), edges, TODAY, scratch.written, max_hops=hops)
    got = {(r.event_id, r.company): (r.score, r.hops, r.stated) for r in found.collect()}
    assert {k: (s, h) for k, (s, h, _) in got.items()} == {k: (-v[0], v[1]) for k, v in best.items()}
    assert all(stated == (h == 1) for _, h, stated in got.values())
    for r in found.collect():
        assert r.path[-1].company == r.company and len(r.path) == r.hops
    two = propagation.event_impact(found, ["E1", "E2"], 2).collect()
    assert {(r.event_id, r.company) for r in two} == {k for k, v in got.items() if k[0] in ("E1", "E2") and v[1] <= 2}


def test_nothing_spreads_from_nothing(spark):
    edges, impacts = graph(spark, 1)
    none = propagation.lifted(impacts.limit(0), spark.createDataFrame([], "key string, parent string, unit string"))
    assert propagation.spread(none, edges, TODAY, scratch.written, max_hops=3).count() == 0
    alone = propagation.lifted(impacts, spark.createDataFrame([], "key string, parent string, unit string"))
    assert {r.hops for r in propagation.spread(alone, edges.limit(0), TODAY, scratch.written).collect()} == {1}


def turns(rows, limit):
    by = {}
    for r in sorted(rows, key=lambda r: r[2]):
        by.setdefault(r[1], []).append(r)
    for e in by:
        by[e].sort(key=lambda r: not r[3])
    quota, left = dict.fromkeys(by, 0), limit
    while left and any(quota[e] < len(by[e]) for e in by):
        for e in by:
            if left and quota[e] < len(by[e]):
                quota[e], left = quota[e] + 1, left - 1
    return {r for e in by for r in by[e][: quota[e]]}, {(r[0][0], e, len(r) - quota[e]) for e, r in by.items() if len(r) > quota[e]}


@pytest.mark.parametrize("limit", [1, 4, 15, 100])
def test_lines_in_turns(spark, limit):
    rng = random.Random(limit)
    rows = [(a, f"E{rng.choice([0, 0, 0, 1, 2, 3])}", i, rng.random() < 0.2, f"c{i}") for a in range(4) for i in range(rng.choice([0, 3, 30]))]
    want = [turns([r for r in rows if r[0] == a], limit) for a in range(4)]
    kept, dropped = propagation.fair_lines(spark.createDataFrame(rows, "answer_id int, event_id string, pos int, stated boolean, company string"), limit)
    assert {tuple(r) for r in kept.collect()} == set().union(*(k for k, _ in want))
    assert {tuple(r) for r in dropped.collect()} == set().union(*(x for _, x in want))


def test_legs_and_reach_are_dealt_over_given_tasks(spark):
    edges, impacts = graph(spark, 5)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert any("REPARTITION_BY_NUM" in line and ", 7)" in line for line in plan(propagation.legs(edges, TODAY, 7)).splitlines())
    some = impacts.withColumn("unit", F.lit(None).cast("string"))
    one, other = (propagation.spread(some, edges, TODAY, scratch.written, tasks=n) for n in (None, 7))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert any("REPARTITION_BY_NUM" in line and ", 7)" in line for line in plan(other).splitlines())
