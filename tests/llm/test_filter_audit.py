"""The filter audit against a plain loop over documents and orders."""

from __future__ import annotations

import re
from itertools import permutations

from lodegraph.llm import filter_audit as fa

from .conftest import EDGE, rows_of, table


def brute(rows, labels):
    least, good, toxic = {}, set(), set()
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    parts = {}
    for i, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else "")
        f += ("D" if re.search("[#$%&*|]", t) else "") + ("E" if i is not None and i > least[t] else "")
        parts.setdefault(lang or "", []).append((f, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        removed = {}
        for order in permutations("ABCDE"):
            live = docs
            for k, letter in enumerate(order):
                here, gone = [d for d in live if letter in d[0]], [d for d in docs if letter in d[0] and set(d[0]) & set(order[:k])]
                live = [d for d in live if letter not in d[0]]
                removed[letter] = removed.get(letter, 0) + len(here)
                out.append([part, "".join(order), k + 1, len(live), len(here), len(gone), sum(d[0] == letter for d in docs), sum(d[1] for d in here), sum(d[2] for d in here), letter])
        for r in out:
            if r[0] == part:
                r[-1] = removed[r[-1]]
    return sorted(map(tuple, out))


def words(n, seed=0):
    return " ".join(f"w{(i * 7 + seed) % 991}" for i in range(n))


ROWS = [
    *EDGE,
    (10, words(300), "en", "a"), (11, words(300), "de", "a"), (9, words(300), "en", "b"), (None, words(300), "en", "b"), (12, words(300), None, None),
    (13, words(300)[:-1] + "#", "en", "a"), (14, "X" + words(300)[1:], "", "a"), (15, "A B " * 200, "fr", "a"), (16, "€uro\x0b" * 400, "fr", "a"),
    # equal up to the last of several blocks
    (17, words(900) + "a", "en", "a"), (18, words(900) + "b", "en", "a"), (19, words(900) + "a", "en", "a"),
]
LABELS = [(10, 1, 0), (11, 1, 1), (11, 0, 0), (12, 0, 1), (14, None, 1), (1, 1, None), (None, 1, 1), (19, 1, 1), (99, 1, 1)]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark):
    assert rows_of(fa.audit(table(spark, ROWS, clashing=True), labels(spark))) == brute(ROWS, LABELS)


def test_hot_text(spark, monkeypatch):
    """Classes above the hot share go by broadcast, the others by shuffling; both mark all but the least id."""
    rows = [(i, "same text" if i % 3 else words(250, i // 2), "en", "a") for i in range(600)]
    monkeypatch.setattr(fa, "HOT_SHARE", 10)
    assert rows_of(fa.audit(table(spark, rows), labels(spark))) == brute(rows, LABELS)


def test_colliding_hashes(spark, monkeypatch):
    """Texts whose hashes are all equal are told apart by comparing them."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(fa, "block_hashes", lambda text, ends: F.array(F.lit(1).cast("long")))
    assert rows_of(fa.audit(table(spark, ROWS), labels(spark))) == brute(ROWS, LABELS)
    monkeypatch.setattr(fa, "MOST_BROADCAST", 0)
    assert rows_of(fa.audit(table(spark, ROWS), labels(spark))) == brute(ROWS, LABELS)


def test_empty(spark, none):
    assert fa.audit(none, labels(spark)).count() == 0
    assert rows_of(fa.audit(table(spark, ROWS), labels(spark).limit(0))) == brute(ROWS, [])
