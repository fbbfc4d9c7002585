from __future__ import annotations

import numpy as np
import pytest

from lodegraph.llm import near_copies

from .conftest import EDGE, table
from .test_simhash import reach

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(r, words, changes):
    words = list(words)
    for at in r.choice(len(words) - 4, changes, replace=False):
        words[at + 2] = f"changed{r.integers(1 << 30)}"
    return words


def kept_by_brute_force(rows):
    sets = {i: shingles(t) for i, (_, t, *_) in enumerate(rows)}
    group = reach(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[group[i]] = min(least.get(group[i], doc_id), doc_id)
    return sorted(set(least.values()))


def test_stage_finds_edited_copies(spark):
    """Pairs of similarity 0.7 to 1 and exact copies, on both sides of the threshold."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(60):
        base = [f"w{x}" for x in r.integers(0, 5000, 200 if i % 2 else 500)]
        rows.append((2 * i, " ".join(base), "en", "web"))
        rows.append((2 * i + 1, " ".join(edited(r, base, (i % 12) * len(base) // 200)).upper(), "en", "web"))
    found = [jaccard(shingles(rows[i][1]), shingles(rows[i + 1][1])) for i in range(0, 120, 2)]
    assert sum(0.8 <= j < 0.95 for j in found) >= 15
    assert sum(0.7 <= j < 0.8 for j in found) >= 8
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows).repartition(4), "")
    assert sorted(x.doc_id for x in got.collect()) == kept_by_brute_force(rows)


def test_large_bands_join_what_their_groups_do_not(spark, monkeypatch):
    """Chains of edits, each text similar only to those near it, with bands fuller than a group."""
    r = np.random.default_rng(6)
    rows = []
    for chain in range(3):
        words = [f"c{chain}w{x}" for x in r.integers(0, 5000, 200)]
        for i in range(40):
            rows.append((1000 * chain + i, " ".join(words), "en", "web"))
            words = edited(r, words, 2)
    for most in (2, 16):
        monkeypatch.setattr(near_copies, "GROUP_TEXTS", most)
        got = near_copies.one_per_group(table(spark, rows).repartition(4))
        assert sorted(x.doc_id for x in got.collect()) == kept_by_brute_force(rows) == [0, 1000, 2000]


def test_large_group_around_one_text(spark, monkeypatch):
    """Edits of one text, most of them unlike each other: some join it, the others stay apart, in bands of many groups."""
    r = np.random.default_rng(8)
    base = [f"b{x}" for x in r.integers(0, 5000, 150)]
    rows = [(i, " ".join(edited(r, base, int(r.integers(0, 9)))), "en", "web") for i in range(150)]
    kept = kept_by_brute_force(rows)
    assert 5 < len(kept) < 145
    for most in (7, 256):
        monkeypatch.setattr(near_copies, "GROUP_TEXTS", most)
        assert sorted(x.doc_id for x in near_copies.one_per_group(table(spark, rows)).collect()) == kept


def test_group_links_against_all_pairs():
    r = np.random.default_rng(9)
    for n in (2, 5, 40):
        sets = [np.unique(r.integers(0, 14, r.integers(0, 12)).astype(np.uint64)) for _ in range(n)]
        names = [bytes([x]) for x in range(n)]
        for chunks in ([0] * n, [i % 2 for i in range(n)]):
            got = near_copies.group_links(sets, names, chunks, 80)
            pairs = [(names[a], names[b]) for a in range(n) for b in range(a) if jaccard(set(sets[a]), set(sets[b])) >= 0.8]
            pairs = [(a, b) for a, b in pairs if len(set(chunks)) == 1 or (a[0] - b[0]) % 2]
            linked = lambda found: reach(names, lambda a, b: (a, b) in found or (b, a) in found)
            assert linked(set(got)) == linked(set(pairs))


def test_edge_rows(spark, edge, none):
    got = near_copies.one_per_group(edge).collect()
    assert sorted(x.doc_id for x in got if x.doc_id is not None) == kept_by_brute_force(EDGE)
    assert sum(x.doc_id is None for x in got) == 1
    assert near_copies.one_per_group(none).count() == 0


def test_rows_of_one_id(spark):
    """Repeated rows stay once, the least by the other columns; different texts of one id are different documents."""
    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, text, "en", "web"), (1, text, "de", "web"), (1, other, "en", "web"), (2, other, "en", "web"), (3, text, "en", "a")]
    got = near_copies.one_per_group(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == sorted([(1, text, "de"), (1, other, "en")])
