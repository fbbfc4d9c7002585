"""Merging of events: candidates against all pairs, groups against taking pairs one by one, and whole cases."""

from __future__ import annotations

import random

import pytest
import xxhash

from lodegraph.operators import event_merge as em

EVENTS = "event_id string, name string, companies array<string>, subjects array<string>, dates array<string>, degree long"
NODES = "node string, subjects array<string>, low int, high int, recurs boolean"
SIGS = "sig string, companies array<string>, roots array<string>"


@pytest.fixture(scope="module")
def checkpoint():
    from lodegraph.sources import scratch

    return scratch.written


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def hashed(a, b):
    return signed(xxhash.xxh64_intdigest(b.encode(), seed=xxhash.xxh64_intdigest(a.encode(), seed=42)))


def one_by_one(nodes, pairs):
    group = {n[0]: n[0] for n in nodes}
    state = {n[0]: (set(n[1]), n[2], n[3], n[4]) for n in nodes}
    refused = set()
    left = sorted((-s, hashed(a, b), a, b) for a, b, s in pairs)
    while left:
        _, _, a, b = left.pop(0)
        x, y = sorted((group[a], group[b]))
        if x == y:
            continue
        (sx, lx, hx, rx), (sy, ly, hy, ry) = state[x], state[y]
        lows, highs = [v for v in (lx, ly) if v is not None], [v for v in (hx, hy) if v is not None]
        span = max(highs) - min(lows) if lows else 0
        if (sx and sy and not sx & sy) or ((rx or ry) and span >= em.MOST_MONTHS):
            left = [p for p in left if {group[p[2]], group[p[3]]} != {x, y}]
            refused.add((x, y))
            continue
        state[x] = (sx | sy, min(lows, default=None), max(highs, default=None), rx or ry)
        group = {n: x if g == y else g for n, g in group.items()}
    return {n: group[n] for p in pairs for n in p[:2]}


@pytest.mark.parametrize(("seed", "most"), [(0, 0), (1, 0), (2, 20), (0, None), (3, None), (4, None)])
def test_groups_are_those_of_one_pair_at_a_time(spark, checkpoint, seed, most):
    rng = random.Random(seed)
    n = 24
    nodes = []
    for i in range(n):
        low = rng.choice([None, rng.randrange(60)])
        nodes.append((f"n{i:02}", rng.sample("abcd", rng.choice([0, 1, 1, 2])), low, None if low is None else low + rng.choice([0, 0, 3]), rng.random() < 0.4))
    pairs = sorted({(*sorted(rng.sample([x[0] for x in nodes], 2)),) for _ in range(45)})
    pairs = [(a, b, rng.choice([0.6, 0.8, 1.0])) for a, b in pairs]
    got = em.closed(spark.createDataFrame(nodes, NODES), spark.createDataFrame(pairs, "a string, b string, alike double"), checkpoint, most_pairs=most)
    assert {r.node: r.grp for r in got.collect()} == one_by_one(nodes, pairs)


@pytest.mark.parametrize(("seed", "most"), [(5, 0), (6, 30)])
def test_groups_by_levels_are_those_of_one_pair_at_a_time(spark, checkpoint, seed, most):
    rng = random.Random(seed)
    nodes = []
    for i in range(40):
        low = rng.choice([None, rng.randrange(40)])
        nodes.append((f"n{i:02}", rng.sample("ab", rng.choice([0, 1, 1])), low, None if low is None else low + rng.choice([0, 3]), rng.random() < 0.4))
    pairs = sorted({(*sorted(rng.sample([x[0] for x in nodes], 2)),) for _ in range(90)})
    pairs = [(a, b, rng.choice([0.6, 0.8, 1.0])) for a, b in pairs]
    got = em.closed(spark.createDataFrame(nodes, NODES), spark.createDataFrame(pairs, "a string, b string, alike double"), checkpoint, most_pairs=most)
    assert {r.node: r.grp for r in got.collect()} == one_by_one(nodes, pairs)


def test_a_hub_takes_many_pairs_in_a_round(spark, checkpoint):
    nodes = [(f"n{i:02}", [], None, None, False) for i in range(40)]
    pairs = [("n00", f"n{i:02}", -1.0, i) for i in range(1, 40)]
    got = em.in_rounds(spark.createDataFrame(nodes, NODES), spark.createDataFrame(pairs, "a string, b string, s double, h long"), checkpoint, most_rounds=4)
    assert {r.grp for r in got.collect()} == {"n00"}


def test_too_many_rounds_are_an_error(spark, checkpoint):
    nodes = [(f"n{i}", [], None, None, False) for i in range(4)]
    pairs = [("n0", "n1", -0.6, 0), ("n1", "n2", -0.8, 0), ("n2", "n3", -1.0, 0)]
    with pytest.raises(RuntimeError):
        em.in_rounds(spark.createDataFrame(nodes, NODES), spark.createDataFrame(pairs, "a string, b string, s double, h long"), checkpoint, most_rounds=1)


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_candidates_against_all_pairs(spark, least):
    rng = random.Random(7)
    rows = [(f"s{i:03}", rng.sample(["c1", "c2", "c3"], rng.choice([0, 1, 2])), sorted(rng.sample("가나다라마바사아자차", rng.randrange(6)))) for i in range(120)]
    want = set()
    for a in rows:
        for b in rows:
            both = set(a[2]) & set(b[2])
            if a[0] < b[0] and set(a[1]) & set(b[1]) and both and len(both) / min(len(a[2]), len(b[2])) >= least:
                want.add((a[0], b[0], round(len(both) / min(len(a[2]), len(b[2])), 3)))
    got = [tuple(r) for r in em.candidates(spark.createDataFrame(rows, SIGS), least=least).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def ev(i, name, companies, subjects, dates, degree=1):
    return (i, name, companies, subjects, dates, degree)


CASES = [
    # one event under two names; a month apart
    ev("a1", "청주 공장 화재", ["하이닉스"], ["하이닉스"], ["2024-03-02"], 3), ev("a2", "청주 공장 화재 사고", ["하이닉스", "한미"], ["하이닉스"], ["2024-04-01"], 5),
    # the same a year and more later: another fire
    ev("a3", "청주 공장 화재", ["하이닉스"], ["하이닉스"], ["2025-09-01"]),
    # same name, disjoint subjects, a company in common
    ev("b1", "자사주 소각 결정", ["한미", "네이버"], ["한미"], ["2024-01-01"]), ev("b2", "자사주 소각 결정", ["한미", "네이버"], ["네이버"], ["2024-01-01"]),
    # goes on for years without recurring
    ev("c1", "세종 신사옥 착공", ["네이버"], ["네이버"], ["2022-03-01"]), ev("c2", "세종 신사옥 준공", ["네이버"], ["네이버"], ["2025-11-01"]),
    # alike only in the company's own name
    ev("d1", "한미 수주", ["한미"], [], None), ev("d2", "한미 감산", ["한미"], [], None),
    # equal in everything
    ev("e1", "테일러 팹 건설", ["삼성"], None, []), ev("e2", "테일러 팹 건설", ["삼성"], None, []), ev("e3", "테일러 팹 건설", [], None, []), ev("e4", "테일러 팹 건설", None, None, None), ev("e5", None, ["삼성"], None, None), ev("e6", "", ["삼성", None], [None], [None, "x"]),
    # recurs and spans a year by itself
    ev("f1", "노조 총파업 결의", ["기아"], ["기아"], ["2022-01-01", "2024-01-01"]), ev("f2", "노조 총파업 결의", ["기아"], ["기아"], ["2022-01-01", "2024-01-01"]),
]


def test_whole_cases(spark, checkpoint):
    events = spark.createDataFrame(CASES, EVENTS)
    groups = em.merge(events, checkpoint)
    of = {r.event_id: r.grp for r in groups.collect()}
    assert of == {"a1": "a1", "a2": "a1", "a3": "a3", "b1": "b1", "b2": "b2", "c1": "c1", "c2": "c1", "d1": "d1", "d2": "d2", "e1": "e1", "e2": "e1", "e3": "e3", "e4": "e4", "e5": "e5", "e6": "e6", "f1": "f1", "f2": "f2"}
    lines = {r.grp: r for r in em.timelines(events, groups).collect()}
    assert lines["a1"].keeper == "a2" and [tuple(t) for t in lines["a1"].timeline] == [("2024-03", "청주 공장 화재", "a1"), ("2024-04", "청주 공장 화재 사고", "a2")]
    assert set(lines) == {"a1", "c1", "e1"}


def test_verdicts_decide(spark, checkpoint):
    verdicts = spark.createDataFrame([("a2", "a1", "different"), ("a3", "a1", "same"), ("c2", "c1", "phase"), ("d1", "d2", "same"), ("b2", "b1", "same"), ("e1", "zz", "same")], "a string, b string, verdict string")
    of = {r.event_id: r.grp for r in em.merge(spark.createDataFrame(CASES, EVENTS), checkpoint, verdicts=verdicts).collect()}
    assert {k for k, v in of.items() if k != v} == {"c2"}


def test_no_events(spark, checkpoint):
    assert em.merge(spark.createDataFrame([], EVENTS), checkpoint).count() == 0


def test_query_over_all_events(spark):
    from lodegraph.plans import catalogue, event_queries

    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in em.prepared(event_queries.named_events(spark, sf)).collect()]
    pairs = []
    for i, a in enumerate(rows):
        for b in rows[:i]:
            both = set(a["roots"]) & set(b["roots"])
            alike = len(both) / min(len(a["roots"]), len(b["roots"]))
            if both and alike >= 0.6 and set(a["companies"]) & set(b["companies"]):
                pairs.append((*sorted((a["event_id"], b["event_id"])), round(alike, 3)))
    # events that agree in everything are one node there, so they are here too
    first = {}
    same = {r["event_id"]: first.setdefault(str([r[c] for c in ("companies", "subjects", "roots", "low", "high", "recurs")]), r["event_id"]) for r in sorted(rows, key=lambda r: r["event_id"])}
    nodes = [(r["event_id"], r["subjects"], r["low"], r["high"], r["recurs"]) for r in rows if same[r["event_id"]] == r["event_id"]]
    merged = one_by_one(nodes, {(a, b, s) for a, b, s in pairs if same[a] == a and same[b] == b})
    got = {r.event_id: r.grp for r in catalogue.queries()["event_merge_groups"](spark, sf).collect()}
    assert len(got) == 1000 and got == {i: merged.get(same[i], same[i]) for i in got} | {i: i for i in got if i not in same}
    assert len(set(got.values())) < 900
    assert {r.grp for r in catalogue.queries()["event_merge_timelines"](spark, sf).collect()} == {g for g in got.values() if list(got.values()).count(g) > 1}


@pytest.mark.parametrize(("seed", "most"), [(8, 25), (9, None)])
def test_groups_by_ranges_are_those_of_one_pair_at_a_time(spark, checkpoint, seed, most):
    rng = random.Random(seed)
    sigs = []
    for i in range(70):
        low = rng.choice([None, rng.randrange(40)])
        sigs.append((f"s{i}", rng.sample(["c1", "c2", "c3"], rng.choice([0, 1, 1, 2])), sorted(rng.sample("가나다라마", rng.randrange(5))), rng.sample("ab", rng.choice([0, 1, 1])), low, None if low is None else low + rng.choice([0, 3]), rng.random() < 0.4))
    alike = lambda a, b: round(len(set(a) & set(b)) / min(len(a), len(b)), 3) if a and b else 0
    pairs = [(a[0], b[0], alike(a[2], b[2])) for a in sigs for b in sigs if a[0] < b[0] and set(a[1]) & set(b[1]) and alike(a[2], b[2]) >= 0.5]
    want = one_by_one([(a[0], *a[3:]) for a in sigs], pairs)
    df = spark.createDataFrame(sigs, f"{SIGS}, subjects array<string>, low int, high int, recurs boolean")
    got = {r.node: r.grp for r in em.by_range(df, checkpoint, least=0.5, most=most).collect()}
    assert got == {a[0]: want.get(a[0], a[0]) for a in sigs} and len(pairs) > 300


def test_pairs_of_like_events_are_not_all_listed(spark, checkpoint, monkeypatch):
    # 120 events of one company and name, in 120 months: 7,140 pairs
    monkeypatch.setattr(em, "MOST_PAIRS", 500)
    written = []
    events = [ev(f"e{i:03}", "세종 신사옥 착공", ["네이버"], [], [f"{2000 + i // 12}-{i % 12 + 1:02}-01"]) for i in range(120)]
    got = em.merge(spark.createDataFrame(events, EVENTS), lambda df: [t := checkpoint(df), written.append(t.count())][0])
    assert {r.grp for r in got.collect()} == {"e000"} and max(written) < 2500


def test_places_in_the_order_of_pairs():
    sizes = [100, 10, 1000]
    assert em.range_end(0.0, 50, sizes) == 0.5 and em.range_end(0.5, 60, sizes) == 2.0 and em.range_end(2.5, 10**6, sizes) == 3.0
    assert em.of_range(0.5, 2.25, sizes) == 50 + 10 + 250


def test_timelines_without_a_list_of_pairs(spark, tmp_path, monkeypatch):
    from lodegraph.plans import catalogue
    from lodegraph.sources import scratch

    # 120 events of one name at one company, each with another one: 7,140 pairs
    spark.createDataFrame([(20 + 504 * k, 5 + 199 * k) for k in range(120)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    kept, rows = scratch.written, []
    monkeypatch.setattr(scratch, "written", lambda df: [t := kept(df), rows.append(t.count())][0])
    monkeypatch.setattr(em, "MOST_PAIRS", 500)
    got = catalogue.queries()["event_merge_timelines"](spark, str(tmp_path)).collect()
    assert [len(r.timeline.split(";")) for r in got] == [120] and max(rows) < 2500
