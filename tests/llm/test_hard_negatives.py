"""Hard negatives against all products of a small table."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lodegraph.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, norm2 string, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA)


def brute(rows, every, positives, negatives, low, high):
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for i, v, label in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, w, other in good)  # noqa: B905  shorter vectors end in zeros
        same = [(s, j) for s, j, own in scored if own and j != i][:positives]
        for ps, p in same:
            window = [(s, j) for s, j, own in scored if not own and -ps * low <= -100 * s <= -ps * high][:negatives]
            out += [(i, p, rank + 1, j, -ps, -s) for rank, (s, j) in enumerate(window)]
    return sorted(out)


def clustered(n, dim, clusters, labels, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(i, [float(x) for x in centres[i % clusters] * rng.uniform(0.5, 1.5) + spread * rng.normal(size=dim)], int(rng.integers(labels))) for i in range(n)]


def check(spark, rows, **kw):
    options = {"every": 10, "positives": 3, "negatives": 4, "low": 30, "high": 90} | kw
    got = sorted(tuple(r) for r in hn.hard_negatives(table(spark, rows), **options).collect())
    assert got == brute(rows, *options.values())
    return got


def test_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(hn, "SAMPLE", 64)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 50)
    monkeypatch.setattr(hn, "GROUP_ANCHORS", 10)
    monkeypatch.setattr(hn, "HELD_PAIRS", 100)
    monkeypatch.setattr(hn, "HELD_GROUPS", 1)
    assert check(spark, clustered(900, 6, 9, 3, 1))


def test_edge_rows(spark):
    rows = clustered(80, 4, 4, 2, 2)
    rows += [rows[10], rows[11], (20, [0.5, 0.5, 0.5, 0.5], 1), (30, [0.5, 0.5], 0)]  # rows and ids that repeat, a shorter vector
    rows += [(100, None, 1), (None, [1.0] * 4, 1), (110, [1.0] * 4, None), (120, [1.0, None, 1.0, 1.0], 1), (130, [math.nan] * 4, 1), (140, [math.inf, 0.0, 0.0, 0.0], 1), (150, [], 1), (160, [0.0] * 4, 0), (-10, [1.0] * 4, 1)]
    check(spark, rows)


def test_ties(spark):
    rows = [(i, [1.0 if i % 2 else 0.5, 0.0], i % 3) for i in range(300)]
    check(spark, rows, low=0, high=100)


def test_few_or_none(spark):
    assert check(spark, []) == [] and check(spark, [(0, [1.0], 1)]) == [] and check(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    check(spark, [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.5, 0.5], 2)])


def test_bounds_exclude_rows(spark, monkeypatch):
    """With clusters a group's tasks get only a part of the rows, and nothing is lost."""
    sent = []
    kept = hn.replicated
    monkeypatch.setattr(hn, "replicated", lambda *a: sent.append(kept(*a)) or sent[-1])
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.eye(3)[i % 3] + 0.01 * rng.normal(size=3)], i % 2) for i in range(600)]
    check(spark, rows, every=1)
    n_groups = len({(r["pivot"], r["part"]) for r in sent[0].select("pivot", "part").collect()})
    assert n_groups > 1 and sum(len(r["ids"]) // 8 for r in sent[0].select("ids").collect()) < 0.8 * n_groups * len(rows)


def test_great_norms(spark):
    rng = random.Random(5)
    check(spark, [(i, [rng.uniform(-5000, 5000) for _ in range(5)], i % 2) for i in range(60)])
    with pytest.raises(ValueError, match="squared norm"):
        hn.hard_negatives(table(spark, [(0, [1e30], 1)]))
