from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from lodegraph.llm import common, simhash

from .conftest import EDGE, rows_of, table


def fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def reach(values, near):
    """Least member that each can reach, by brute force."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {v: find(v) for v in values}


def brute(rows):
    prints = [(d, fingerprint(t)) for d, t, *_ in rows]
    comp = reach(sorted({f for _, f in prints}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, f in prints:
        if d is not None:
            least[comp[f]] = min(least.get(comp[f], d), d)
    return sorted([(d, f"{f:016x}", least.get(comp[f])) for d, f in prints], key=lambda r: [(x is not None, x) for x in r])


def test_fingerprints_and_components(spark):
    r = np.random.default_rng(1)
    base = [" ".join(f"W{x}" for x in r.integers(0, 300, 400)) for _ in range(12)]
    rows = []
    for i in range(90):
        words = base[i % 12].split()
        for _ in range(i % 4):
            words[r.integers(0, len(words))] = "changed"
        rows.append((1000 - i, " ".join(words), "en", "web"))
    assert rows_of(simhash.simhash_components(table(spark, rows).repartition(6))) == brute(rows)


@pytest.mark.parametrize("most", [0, 3, 32])
def test_links_lose_no_connection(spark, most):
    r = np.random.default_rng(2)
    centres = r.integers(-(1 << 63), 1 << 63, 6)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(25):
            v = int(c)
            for b in r.integers(0, 64, r.integers(1, 4)):
                v ^= (1 << int(b)) if b < 63 else -(1 << 63)
            values.add(v)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    pairs = simhash.links(fps, most)
    for a, b in pairs.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    got = {r.node: r.component for r in common.components(pairs).collect()}
    want = reach(sorted(values), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {v: got.get(v, v) for v in values} == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(301)}, 6000: 6000, 6001: 6000}


def test_edge_rows(spark, edge, none):
    assert rows_of(simhash.simhash_components(edge)) == brute(EDGE)
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.one_per_component(edge)
    assert kept.columns == edge.columns
    comp = brute(EDGE)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, _, c in comp if c is not None})
    assert kept.where("doc_id is null").count() == 1
    assert simhash.one_per_component(none).count() == 0


def kept_by_brute_force(rows, k=5):
    """Least doc_id of each group linked by fingerprints of k-word shingles within two bits."""
    prints = [(d, fingerprint(t, k)) for d, t, *_ in rows if d is not None]
    comp = reach(sorted({f for _, f in prints}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, f in prints:
        least[comp[f]] = min(least.get(comp[f], d), d)
    return sorted(set(least.values()))


def test_rows_of_one_id(spark):
    """Repeated rows stay once, the least by the other columns; different texts of one id are different documents."""
    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, text, "en", "web"), (1, text, "de", "web"), (1, other, "en", "web"), (2, other, "en", "web"), (3, text, "en", "a")]
    got = simhash.one_per_component(table(spark, rows), shingle=5).collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == sorted([(1, text, "de"), (1, other, "en")])


def test_links_of_five_words_are_near_copies():
    """What two bits link has a Jaccard similarity of 0.8 or more; unlike texts never link."""
    r = np.random.default_rng(7)
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    linked = 0
    for i in range(200):
        words = [f"w{x}" for x in r.integers(0, 5000, 200)]
        other = list(words)
        for at in r.choice(190, i % 8, replace=False):
            other[at + 2] = f"changed{r.integers(1 << 30)}"
        a, b = sets(words), sets(other)
        if (fingerprint(" ".join(words), 5) ^ fingerprint(" ".join(other), 5)).bit_count() <= 2:
            linked += 1
            assert len(a & b) >= 0.8 * len(a | b)
    assert linked > 25
