"""Names of products: fixed points and pairs; splits: states against a replay, and rolling back."""

from __future__ import annotations

import random

import pytest

from lodegraph.functions import products as P
from lodegraph.operators import repairs, splits
from pyspark.sql import functions as F

EQUAL = [("열압착(TC) 본더", "TC 본더"), ("열압착장비(TC본더)", "TC 본더"), ("고대역폭메모리(HBM)", "HBM"), ("NAND Flash", "낸드플래시"), ("서버 D램", "서버 DRAM"), ("전력반도체(SiC)", "SiC"), (" hbm ", "HBM"), ("차량용（mcu）", "MCU")]
DIFFERENT = [("HBM", "HBM3"), ("HBM", "HBM4"), ("HBM3", "HBM3E"), ("HBM4", "HBM4E"), ("DRAM", "범용 DRAM"), ("DRAM", "서버 D램"), ("메모리", "비메모리"), ("로봇", "협동로봇"), ("로봇", "산업용 로봇"), ("TC 본더", "TC 본더 4.5 그리핀"), ("SSD(Bravo)", "SSD"), ("램(AP)", "AP")]


def keys(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", P.canonical_product(F.col("n")).alias("p"), P.canonical_key(F.col("n")).alias("k"))
    return {r.n: (r.p, r.k) for r in df.collect()}


def test_names_that_meet_and_names_that_do_not(spark):
    of = keys(spark, {n for pair in EQUAL + DIFFERENT for n in pair})
    assert all(of[a][1] == of[b][1] for a, b in EQUAL), [(a, of[a]) for a, b in EQUAL if of[a][1] != of[b][1]]
    assert all(of[a][1] != of[b][1] for a, b in DIFFERENT)


def test_every_rule_ends_in_a_fixed_point(spark):
    """What a name becomes stays when the rules are run on it again, whatever the order of names."""
    names = [k for ks in P.WHOLE.values() for k in ks] + list(P.WHOLE) + list(P.WORDS) + list(P.WORDS.values()) + [a for a, _ in EQUAL + DIFFERENT] + [f"서버 {w} 모듈" for w in P.WORDS] + ["", "  ", "(HBM)", "x (y) z", "a　b"]
    once = keys(spark, set(names))
    again = keys(spark, {p for p, _ in once.values()})
    assert {p: again[p][1] for p, _ in once.values()} == {p: k for p, k in once.values()}
    assert keys(spark, [None])[None] == ("", "")
    for product, known in P.WHOLE.items():
        assert {once[k][0] for k in known} == {product}


@pytest.mark.parametrize("seed", range(3))
def test_states_against_a_replay(spark, seed):
    rng = random.Random(seed)
    at = {f"e{i}": f"E{i % 4}" for i in range(30)}
    edges = spark.createDataFrame([(e, v, f"d{e}") for e, v in at.items()], "edge_id string, event_id string, doc string")
    now, log, states = dict(at), [], {0: dict(at)}
    for change in range(1, 7):
        for e in rng.sample(sorted(now), rng.randrange(12)):
            log.append((change, e, now[e], f"E{change}x"))
            now[e] = f"E{change}x"
        states[change] = dict(now)
    moves = spark.createDataFrame(log, "change long, edge_id string, before string, after string")
    read = lambda df: {r.edge_id: r.event_id for r in df.collect()}
    for change, want in states.items():
        assert read(splits.state(edges, moves, as_of=change)) == want
    assert read(splits.state(edges, moves.unionByName(splits.inverse(moves, 6)))) == at
    out = set(rng.sample(range(1, 7), 2))
    want = dict(at)
    for change, e, _, after in log:
        want[e] = want[e] if change in out else after
    assert read(splits.state(edges, moves, undone=spark.createDataFrame([(c,) for c in out], "change long"))) == want


def test_a_split_is_undone_to_what_was(spark):
    edges = spark.createDataFrame([("1", "e", "d1"), ("2", "e", "d1"), ("3", "e", "d2"), ("4", "e", "d3"), ("5", "f", "d1"), ("6", "e", None)], "edge_id string, event_id string, doc string")
    verdicts = spark.createDataFrame([("e", "strike", "d1"), ("e", "fire", "d2"), ("e", "fire", "d3"), ("f", "one", "d1")], "event_id string, label string, doc string")
    keys_, moved = repairs.split_events(verdicts, edges)
    log = splits.moves(edges, keys_, 1)
    rows = lambda df: sorted(map(tuple, df.select("edge_id", "event_id", "doc").collect()), key=str)
    assert rows(splits.state(edges, log)) == rows(moved) != rows(edges)
    assert rows(splits.state(edges, log.unionByName(splits.inverse(log, 1)))) == rows(edges)


def test_phases_go_to_the_nearest_part_once(spark):
    old = ["2024-11|a|1", "2026-05|b|2", "2020-01|far|3", "none|c|4", "2025-03|middle|5"]
    parts = spark.createDataFrame([("e", "p", old), ("e", "q", old), ("g", "h", None), ("gone", "r", old)], "orig_id string, new_id string, orig_timeline array<string>")
    edges = spark.createDataFrame([("e", "2026-01-05"), ("e", "2026-06"), ("p", "2024-10-01"), ("q", None), ("g", "2024-01-01")], "event_id string, occurred_at string")
    events = spark.createDataFrame([("e", ["2026-09|later|9", "2024-11|a|1"]), ("p", None), ("q", []), ("g", ["keep"]), ("h", None), ("z", ["x"])], "event_id string, timeline array<string>")
    want = {"e": ["2026-09|later|9", "2026-05|b|2"], "p": ["2024-11|a|1", "2025-03|middle|5"], "q": []}
    got = {r.event_id: r.timeline for r in splits.dealt_phases(events, parts, edges).collect()}
    assert got == want
    again = spark.createDataFrame([(k, v) for k, v in got.items()], "event_id string, timeline array<string>")
    assert {r.event_id: r.timeline for r in splits.dealt_phases(again, parts, edges).collect()} == want
