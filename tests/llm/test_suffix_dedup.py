from __future__ import annotations

import hashlib

import numpy as np
import pytest

from lodegraph.llm import suffix_dedup

from .conftest import EDGE, rows_of, table


def brute(rows, length):
    """The contract, window by window. Equal (doc_id, start) are not earlier than each other; null ids come first."""
    first = {}
    key = lambda d: (d is not None, d or 0)
    raw = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w not in first or (key(d), i) < first[w]:
                first[w] = (key(d), i)
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (key(d), i):
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def corpus(seed, docs=60):
    r = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(1, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (17, 25, 60, 200)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(r.integers(1, 6)):
            p = passages[r.integers(0, len(passages))]
            a = r.integers(0, max(len(p) - 101, 1))
            parts += [" ".join(word() for _ in range(r.integers(0, 30))), p[a : a + r.integers(95, 400)]]
        rows.append((i, " ".join(parts), "en", "web"))
    rows += [(docs, rows[3][1], "en", "web"), (docs + 1, "x" * 99, "en", "web"), (docs + 2, "x" * 350, "en", "web"), (docs + 3, "x" * 120 + "é" * 80, "en", "web"), (3, rows[3][1], "en", "web")]
    rows += [(docs + 4, "ab" * 300, "en", "web"), (docs + 5, "y" + "ab" * 200, "en", "web")]
    return rows


@pytest.mark.parametrize(("seed", "length", "most_runs"), [(1, 100, 1000), (2, 100, 2), (3, 60, 1000)])
def test_against_brute_force(spark, seed, length, most_runs):
    rows = corpus(seed)
    got = suffix_dedup.suffix_dedup(table(spark, rows).repartition(5), length=length, most_runs=most_runs).drop("kept")
    assert rows_of(got) == brute(rows, length)


def test_equal_windows_of_pieces():
    r = np.random.default_rng(0)
    shared = bytes(r.integers(97, 100, 70).tolist())
    pieces = [bytes(r.integers(97, 100, k).tolist()) + shared + bytes(r.integers(97, 100, 20).tolist()) for k in (5, 9, 14, 9)]
    anchors = np.array([5, 9, 14, 9])
    counts = np.array([len(p) - 50 + 1 for p in pieces])
    doc, start = np.arange(4), np.zeros(4, np.int64)
    got = {(int(w), int(o)) for who, off in suffix_dedup.equal_windows(pieces, counts, anchors, doc, start, 50) for w, o in zip(who, off, strict=True)}
    # equal windows stand at equal places before the anchor
    want = set()
    for i, p in enumerate(pieces):
        for o in range(counts[i]):
            for j in range(i):
                q = o - anchors[i] + anchors[j]
                if 0 <= q < counts[j] and pieces[j][q : q + 50] == p[o : o + 50]:
                    want.add((i, o))
    assert got == want


def test_edge_rows(spark, edge, none):
    rows = [(d, t if t is None else t[:3000], *rest) for d, t, *rest in EDGE]
    assert rows_of(suffix_dedup.suffix_dedup(table(spark, rows, clashing=True)).drop("kept")) == brute(rows, 100)
    long = {r.doc_id: r for r in suffix_dedup.suffix_dedup(edge).collect()}[5]
    assert (long.n_bytes, long.n_bytes - long.n_removed, long.n_spans) == (27 * 40_000, 27, 1)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_one_passage_in_many_contexts(spark):
    """More contexts of one passage than one task sorts, with shared lead-ins: the collection is split, not dropped."""
    r = np.random.default_rng(5)
    letters = lambda n: bytes(r.integers(97, 123, n).tolist()).decode()
    passage, leads = letters(130), [letters(60) for _ in range(3)]
    rows = [(i, letters(r.integers(5, 90)) + leads[i % 3][r.integers(0, 55) :] + passage + letters(r.integers(5, 90)), "en", "web") for i in range(1300)]
    got = suffix_dedup.suffix_dedup(table(spark, rows), length=100).drop("kept")
    assert rows_of(got) == brute(rows, 100)


def test_lengths(spark):
    rows = corpus(9, docs=20)
    got = suffix_dedup.suffix_dedup(table(spark, rows), length=170, most_runs=2).drop("kept")
    assert rows_of(got) == brute(rows, 170)
    for length in (32, 1055):
        with pytest.raises(ValueError, match="length"):
            suffix_dedup.suffix_dedup(table(spark, rows), length=length)
