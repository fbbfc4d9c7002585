"""Firms by common members against all pairs, and persons that are one against a closure."""

from __future__ import annotations

import random

import pytest

from lodegraph.operators import people
from lodegraph.plans import catalogue, person_queries
from lodegraph.sources import scratch

SF = "/root/testdata/sf0.001"


def pairs_of(rows, overlap):
    rosters = {}
    for c, m in rows:
        if c is not None and m is not None:
            rosters.setdefault(c, set()).add(m)
    return {(a, b, len(rosters[a] & rosters[b])) for a in rosters for b in rosters if a < b and len(rosters[a] & rosters[b]) >= overlap}


@pytest.mark.parametrize("overlap", [1, 2, 4])
def test_pairs_against_all(spark, overlap):
    rng = random.Random(overlap)
    # one member sits in every firm
    rows = [(c, m) for c in range(40) for m in [0, *rng.sample(range(1, 60), rng.randrange(12))]] + [(None, 1), (3, None), (1, 0)]
    got = [tuple(r) for r in people.roster_pairs(spark.createDataFrame(rows, "company int, member int"), overlap).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_of(rows, overlap)


def test_pairs_meet_without_their_rosters(spark):
    rows = [(c, m) for c in range(60) for m in range(60)]
    df = people.roster_pairs(spark.createDataFrame(rows, "company int, member int"), 2, scratch.written)
    assert df.count() == 60 * 59 // 2 and {r.n for r in df.collect()} == {60}
    # whole rosters come along with pairs only, not with each member by which a pair meets
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grouped = [line for line in plan if "Aggregate [" in line]
    assert grouped and not any("of_" in line for line in grouped)


def closure(nodes, links):
    of = {n: {n} for n in nodes}
    for a, b in links:
        if of[a] is not of[b]:
            both = of[a] | of[b]
            for x in both:
                of[x] = both
    return of


def test_query_against_a_closure(spark):
    p = [r.asDict() for r in person_queries.PERSONS.df(spark, SF).collect()]
    rosters = [(r.company, r.member) for r in person_queries.ROSTERS.df(spark, SF).collect() if r.member % 3 == 0]
    firms = closure({r["company"] for r in p} | {c for c, _ in rosters}, [(a, b) for a, b, _ in pairs_of(rosters, 2)])
    block = lambda r: min(firms[r["company"]])
    links = [(x["key"], y["key"]) for i, x in enumerate(p) for y in p[:i] if x["name"] == y["name"] and (block(x) == block(y) or (x["self_owner"] and y["self_owner"]))]
    of, births = closure({r["key"] for r in p}, links), {r["key"]: r["birth"] for r in p}
    want = {}
    for group in {frozenset(g) for g in of.values() if len(g) > 1}:
        first = min((births[k] for k in group if births[k]), default=None)
        parts = {}
        for k in group:
            parts.setdefault(births[k] or first, []).append(k)
        for part in parts.values():
            keep = min(part, key=lambda k: (births[k] is None, k))
            want |= {k: keep for k in part if k != keep}
    got = {r.key: r.keep for r in catalogue.queries()["person_merge"](spark, SF).collect()}
    assert got == want and want


def test_nobody(spark):
    none = spark.createDataFrame([], "company int, member int")
    assert people.roster_pairs(none, 2, scratch.written).count() == 0


def test_rosters_are_written_once_for_persons(spark):
    from lodegraph.operators import people
    from lodegraph.sources import scratch

    written = []
    persons = spark.createDataFrame([("a", "n", None, False), ("b", "n", "1960-01", False)], "key string, name string, birth string, self_owner boolean")
    posts = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, company string")
    rosters = spark.createDataFrame([(c, m) for c in "xy" for m in "mn"], "company string, member string")
    got = people.merge_persons(persons, posts, rosters, lambda df: written.append(df.columns) or scratch.written(df))
    assert [tuple(r) for r in got.collect()] == [("a", "b")] and written.count(["company", "members"]) == 1


def test_query_reads_whole_rosters(spark, tmp_path):
    # firms 1 and 2 have the members 1 and 2 in common; 244 and 41857 bear one name
    spark.createDataFrame([(244, 1), (488, 1), (1253, 2), (41857, 2)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    assert {r.member for r in person_queries.ROSTERS.df(spark, str(tmp_path)).collect()} == {1, 2}
    assert [tuple(r) for r in catalogue.queries()["person_merge"](spark, str(tmp_path)).collect()] == [(41857, 244)]
