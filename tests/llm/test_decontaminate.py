from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from lodegraph.llm import decontaminate

from .conftest import EDGE, rows_of, table


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def brute(rows, items, window=10):
    """The contract, window by window."""
    where = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            where.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in where}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in where:
                    hit |= set(range(i, i + k))
                    found |= where[tuple(w[i : i + k])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def world():
    r = np.random.default_rng(5)
    word = lambda: f"w{r.integers(0, 400)}"
    items = [(i, " ".join(word() for _ in range(int(r.integers(12, 60))))) for i in range(30)]
    items += [(30, "only Four Words here"), (31, "..."), (32, None), (33, "solo"), (34, items[0][1]), (35, "so so so so so so so so so so so so")]
    rows = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(40))]
        w = items[int(r.integers(0, 30))][1].split()
        k = int(r.integers(6, 16))
        a = int(r.integers(0, len(w) - k)) if len(w) > k else 0
        parts += [", ".join(w[a : a + k]).upper(), " ".join(word() for _ in range(20))]
        rows.append((i, " ".join(parts), "en", "web"))
    rows += [(80, "and ONLY-four   words; here", "en", "web"), (81, "solo", "en", "web"), (82, "so " * 40, "en", "web"), (83, items[0][1] + " x " + items[0][1], "en", "web")]
    return rows, items


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 500])
def test_against_brute_force(spark, block_bytes):
    rows, items = world()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(table(spark, rows).repartition(3), benchmark, block_bytes=block_bytes)
    assert rows_of(found.select(COLUMNS)) == brute(rows, items)
    longest = {r.doc_id: r for r in found.collect()}[83]
    assert longest.longest == len(words(items[0][1]))
    assert longest.longest_item in ("0", "34")
    clean = decontaminate.clean_documents(table(spark, rows), benchmark, block_bytes=block_bytes)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in brute(rows, items) if not r[5]}


def test_suffix_array_orders_by_depth():
    r = np.random.default_rng(1)
    seq = np.append(r.integers(0, 4, 300), 0)
    got = decontaminate.suffix_array(seq, 16)
    key = lambda i: [*seq[i : i + 16][: int((seq[i : i + 16] == 0).argmax()) if (seq[i : i + 16] == 0).any() else 16]]
    assert sorted(got.tolist()) == np.flatnonzero(seq).tolist()
    assert all(key(a) <= key(b) for a, b in zip(got[:-1], got[1:], strict=True))


def test_edge_rows(spark, edge, none):
    items = [(1, "the lazy dog"), (None, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem"), (1, "the lazy dog")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(edge, benchmark).select(COLUMNS).collect()}
    assert (got[1].n_hit, got[7].n_hit, got[5].n_hit, got[2].n_words) == (3, 3, 200_000, 0)
    assert got[5].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5].n_items == 1
    empty = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(decontaminate.decontaminate(edge, empty).select(COLUMNS)) == brute(EDGE, [])
    assert decontaminate.decontaminate(none, benchmark).count() == 0
    clean = decontaminate.clean_documents(edge, benchmark)
    assert clean.columns == edge.columns
    assert {r.doc_id for r in clean.collect()} == {None, 2, 3, 4, 6, 8}


def longest(items, doc, window):
    """The longest run of doc's words in any item, by all pairs of places; the least item, the first place of these."""
    best, w = (0, "", 0), words(doc)
    for at in range(len(w)):
        for item, text in items:
            v = words(text)
            for i in range(len(v)):
                k = 0
                while at + k < len(w) and i + k < len(v) and w[at + k] == v[i + k]:
                    k += 1
                if k >= min(window, len(v)) and (k == len(v) or k >= window) and (k > best[0] or (k == best[0] and at == best[2] and item < best[1])):
                    best = (k, item, at)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_longest_match_against_all_places(seed):
    """Few words, so items repeat windows, share them and repeat their ids."""
    r = np.random.default_rng(seed)
    text = lambda n: " ".join(f"w{x}" for x in r.integers(0, 3, n))
    items = [(f"i{k % 6}", text(r.integers(0, 30))) for k in range(9)]
    q = decontaminate.Queries(items, 4)
    for _ in range(40):
        doc = text(r.integers(1, 40)) + " other " + text(3)
        (found,) = decontaminate._matches([((1, 1), q.numbers(doc))], q)
        n, item, at = longest(items, doc, 4)
        assert (found[5], found[6], found[7]) == ((n, item, at) if n else (0, None, None))


def test_item_that_repeats_its_window(spark):
    w = " ".join(f"a{i}" for i in range(10))
    items = spark.createDataFrame([(5, f"{w} x {w} y z q")], "item_id long, text string")
    row = decontaminate.decontaminate(table(spark, [(1, f"pre {w} y z q post", "en", "web")]), items).first()
    assert (row.longest, row.longest_item, row.longest_at, row.n_hit) == (13, "5", 1, 13)


def test_very_long_items(spark):
    """An index takes memory in proportion to the words of its items, whether they vary or repeat."""
    r = np.random.default_rng(2)
    varied, same = " ".join(f"v{x}" for x in r.integers(0, 5000, 50_000)), "so " * 50_000
    q = decontaminate.Queries([("v", varied), ("s", same)], 10)
    assert q.rows.nbytes + q.seq.nbytes + q.places.nbytes + q.of.nbytes + q.end.nbytes < 20 << 20
    items = spark.createDataFrame([(1, varied), (2, same)], "item_id long, text string")
    part = " ".join(varied.split()[20_000:45_000])
    got = {x.doc_id: x for x in decontaminate.decontaminate(table(spark, [(1, "k " + part + " so", "en", "w"), (2, "so " * 300, "en", "w")]), items).collect()}
    assert (got[1].longest, got[1].longest_at, got[1].n_hit) == (25_000, 1, 25_000)
    assert (got[2].longest, got[2].longest_item, got[2].n_hit) == (300, "2", 300)
