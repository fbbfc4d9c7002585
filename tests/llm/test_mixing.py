from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodegraph.llm import common, mixing

from .conftest import EDGE, table


def water_fill(sizes, weights, share, most):
    """Targets by brute force: what exceeds a source's limit is shared again until none does."""
    left, target = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free and left > 1e-9:
        total = sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if target[i] + left * weights[i % len(weights)] / total >= most * sizes[i]]
        if not over:
            for i in free:
                target[i] += left * weights[i % len(weights)] / total
            break
        for i in over:
            left -= most * sizes[i] - target[i]
            target[i] = most * sizes[i]
        free = [i for i in free if i not in over]
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 5, 400], [1, 2, 3, 4, 5, 6, 7], [500], [0, 30, 10], [0, 0]])
def test_targets_against_brute_force(spark, sizes):
    rows = [(chr(97 + i), s) for i, s in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long"), (5, 2, 1), 1.5, 2).orderBy("source").collect()
    assert [r.target for r in got] == pytest.approx(water_fill(sizes, (5, 2, 1), 1.5, 2))


def test_apportion_deals_by_highest_quotients(spark):
    r = np.random.default_rng(0)
    rows, want = [], {}
    for g in range(12):
        n, seats = int(r.integers(1, 9)), int(r.integers(0, 60))
        weights = [int(x) for x in r.integers(0, 30, n)]
        rows += [(g, k, w, seats) for k, w in enumerate(weights)]
        quotients = sorted(((-w / (2 * j - 1), k, j) for k, w in enumerate(weights) if w for j in range(1, seats + 1)))[:seats]
        won = Counter(k for _, k, _ in quotients)
        want |= {(g, k): won[k] for k in range(n)}
    got = mixing.apportion(spark.createDataFrame(rows, "g int, k int, w long, seats long"), ["g"], "k", "w", "seats").collect()
    assert {(x.g, x.k): x.quota for x in got} == want


def corpus():
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        source = ["hot", "hot", "hot", "b", "c", None][i % 6]
        rows.append((i, " ".join(f"w{i}x{k}" for k in range(int(r.integers(0, 120)))), "en", source))
    return [*rows, (399, rows[399][1], "en", rows[399][3])]


def test_mix_meets_targets_and_repeats_itself(spark):
    docs = table(spark, corpus())
    options = {"shard_words": 1500, "block": 8}
    out = mixing.mix(docs, **options).collect()
    again = mixing.mix(docs.repartition(7), **options).collect()
    key = lambda rows: sorted((r.doc_id, r.size, r.taken, r.target) for r in rows)
    assert key(out) == key(again)
    assert len({(r.source, r.shard) for r in out}) > 4  # the hot source is several shards
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.source_size == sum(x.size for x in out if x.source == r.source)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in names] == pytest.approx(water_fill([size[s] for s in names], (5, 2, 1), 1.5, 2))
    for s in names:
        assert abs(taken[s] - target[s]) <= 8 * len({r.shard for r in out if r.source == s}) + 8


def test_mixed_texts_hold_the_words_taken(spark):
    docs = table(spark, corpus()[:-1], clashing=True)
    plan = {r.doc_id: r.taken for r in mixing.mix(docs, block=8).collect()}
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    words, texts = defaultdict(int), {r[0]: r[1] for r in corpus()}
    for r in out.collect():
        own = re.findall(common.WORD, r.text)
        words[r.doc_id] += len(own)
        assert set(own) <= set(texts[r.doc_id].split())
        assert r["_text_hash"] == "own _text_hash"
        assert r.n_chars == len(r.text)
    assert dict(words) == {d: n for d, n in plan.items() if n}


def test_edge_rows(spark, edge, none):
    out = mixing.mix(edge).collect()
    assert len(out) == len(EDGE)
    for r in out:
        assert r.size in {len(re.findall(common.WORD, t or "")) for d, t, *_ in EDGE if d == r.doc_id}
        assert 0 <= r.taken <= 2 * r.size
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(edge).columns == edge.columns
