from __future__ import annotations

import math
import re

import numpy as np
import pytest

from lodegraph.llm import rules

from .conftest import EDGE, table


def repeated(words, window):
    """The contract by brute force."""
    windows = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + window))
    return len(hit)


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 11])
def test_repeated_words_against_brute_force(window):
    r = np.random.default_rng(window)
    for n in (0, 1, window, window + 1, 60, 90):
        for kinds in (1, 2, 4, 40):
            words = [f"w{k}" for k in r.integers(0, kinds, n)]
            assert rules.repeated_words(words, window) == repeated(words, window)


def test_text_measures():
    text = "a b# é\n\na b# é\n  \nx\ta|b"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert rules.text_measures(text)[:5] == (len(words), sum(map(len, words)), 3, 1, 0)
    assert rules.text_measures(None)[:5] == (0, 0, 0, 0, 0)


@pytest.mark.parametrize(("r", "n"), [(0, 10), (1, 10), (3, 40), (10, 10), (0, 0), (17, 400)])
def test_upper_bound_is_the_exact_binomial_one(r, n):
    p = rules.upper_bound(r, n, 0.05)
    if r >= n:
        assert p == 1
    else:
        assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(r + 1)) == pytest.approx(0.05, abs=1e-6)


@pytest.fixture(scope="module")
def labelled(spark):
    """Good texts without symbols; bad ones full of them; too few labels in a third stratum."""
    rows, labels = [], []
    for i in range(3000):
        good = i % 3 != 0
        words = [f"{'wort' if i % 2 else 'word'}{(i * 31 + k * k) % 97}{k}" for k in range(40)]
        rows.append((i, " ".join(words) + (" " + "#$" * 12 if not good else ""), "de" if i % 2 else "en", "web"))
        labels.append((i, int(good), 0))
    rows += [(3000 + i, " ".join(f"rare{k}" for k in range(30)) + " " + "#" * 60, "xx", "web") for i in range(5)]
    labels += [(3000, 0, 0), (3001, 1, 0), (3001, 0, 0), (None, 1, 0), (3002, None, None)]
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_keep_their_promise(spark, labelled):
    docs, labels = labelled
    measured = rules.measure(docs, "lang").selectExpr("*", "n_words < 20 as base_failed")
    chosen = rules.calibrate(measured, labels, alpha=0.05, delta=0.05).collect()
    assert {c.stratum for c in chosen} == {"de", "en"}  # too few labels give no guarantee, so no cutoff
    tests = sum(len(c) for _, c in rules.RULES.values()) * 3
    for c in chosen:
        assert c.bound == pytest.approx(rules.upper_bound(c.rejected_good, c.n_good, 0.05 / tests))
        assert c.bound <= 0.05 / len(rules.RULES)
    out = {r.doc_id: r for r in rules.apply_rules(docs, labels).collect()}
    assert all(out[i].kept == (i % 3 != 0) for i in range(3000))
    assert all(out[3000 + i].kept for i in range(5))
    assert out[0].rejected_by and not out[1].rejected_by


def test_edge_rows(spark, edge, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rules.apply_rules(edge, labels).collect()
    assert len(got) == len(EDGE)
    for r in got:
        text = next(t for d, t, *_ in EDGE if d == r.doc_id) or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert r.n_words == len(words)
        assert r.base_failed == (len(words) < 20 or r.n_repeat_words * 100 > 30 * len(words))
        assert r.kept == (not r.base_failed)
    assert rules.apply_rules(none, labels).count() == 0


def expected_cutoffs(rows, labels, alpha, delta):
    """The choice by brute force: rows of (stratum, text hash, statistics by rule), one per text that passes the base rule."""
    strata = {}
    for stratum, key, value in rows:
        strata.setdefault(stratum, {})[key] = (labels.get(key), value)
    number = {s: sum(g == 1 for g, _ in t.values()) for s, t in strata.items()}
    able = max(sum(n >= math.log(delta) / math.log1p(-alpha) for n in number.values()), 1)
    out = {}
    for s, texts in strata.items():
        share = lambda among, rule, cutoff: sum(v[rule] is not None and v[rule] > cutoff for g, v in texts.values() if g == among) / max(sum(g == among for g, _ in texts.values()), 1)  # noqa: B023, E731
        path = rules.path_of(*[[share(among, rule, cutoff) for rule, _, cutoff in rules.TESTS] for among in (0, None)])
        chosen = {}
        for i in path:
            trial = chosen | {rules.TESTS[i][0]: rules.TESTS[i][2]}
            r = sum(g == 1 and any(v[k] is not None and v[k] > c for k, c in trial.items()) for g, v in texts.values())
            if rules.upper_bound(r, number[s], delta / able) > alpha:
                break
            chosen = trial
        if chosen:
            out[s] = chosen
    return out


def test_joint_choice_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    measured = rules.measure(docs, "lang").selectExpr("*", "n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed").cache()
    good = {r.doc_id: r.quality for r in labels.collect()}
    by_text, rows = {}, {}
    div = lambda a, b: a / b if b else None
    for r in measured.where("not base_failed").collect():
        if good.get(r.doc_id) is not None:
            by_text[r.text_hash] = min(by_text.get(r.text_hash, 1), good[r.doc_id])
        rows[r.stratum, r.text_hash] = {"symbols_per_word": div(r.n_symbols, r.n_words), "shouts_per_word": div(r.n_shouts, r.n_words), "repeated_line_share": div(r.n_dup_lines, r.n_lines), "repeated_word_share": div(r.n_repeat_words, r.n_words), "mean_word_length": div(r.word_chars, r.n_words)}
    for alpha, delta in ((0.05, 0.05), (0.1, 0.2)):
        want = expected_cutoffs([(s, k, v) for (s, k), v in rows.items()], by_text, alpha, delta)
        got = {r.stratum: {k: r[k] for k in rules.RULES if r[k] is not None} for r in rules.calibrate_jointly(measured, labels, alpha=alpha, delta=delta).collect()}
        assert got == want
        assert "en" in got
    out = rules.apply_rules(docs, labels).collect()
    assert any(r.kept != (not r.base_failed) for r in out)
    held = [r for r in out if good.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(not r.kept for r in held) <= 0.05 * len(held)
    assert sum(not r.kept for r in out if good.get(r.doc_id) == 0 and not r.base_failed) > 0


def test_copies_are_one_trial(spark):
    """Fifty-eight good texts can't pass at 5 %, however often they are repeated; fifty-nine can."""
    bad = [(10_000 + i, " ".join(f"bad{i}x{k}" for k in range(30)) + " " + "#$" * 40, "en", "web") for i in range(20)]
    for n in (58, 59):
        rows = [(i, " ".join(f"word{i % n}x{k}" for k in range(30)), "en", "web") for i in range(300)] + bad
        labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(b[0], 0) for b in bad], "doc_id long, quality int")
        kept = {r.doc_id: r.kept for r in rules.apply_rules(table(spark, rows), labels).collect()}
        assert all(kept[i] for i in range(300))
        assert [kept[b[0]] for b in bad] == [n == 58] * 20
