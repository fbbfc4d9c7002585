from __future__ import annotations

import hashlib
import re
import textwrap

import duckdb
import pytest

from lodegraph.llm import licenses
from lodegraph.llm.license_texts import KNOWN

from .conftest import EDGE, table


def test_variants_of_known_texts_match(spark):
    rows, want = [], {}
    for i, (name, text) in enumerate(KNOWN):
        variant = text.upper().replace(" ", "  ", 5) if i % 2 else "Copyright (c) 2020 Some Body\n\n" + text.replace("\n\n", "\n \n")
        rows.append((i, variant, "en", "web"))
        want[i] = licenses.canonical(text)
    names = {}
    for name, text in KNOWN:
        names[licenses.canonical(text)] = name
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    for i, c in want.items():
        assert got[i].license == names[c], KNOWN[i][0]
        assert got[i].digest == hashlib.sha256(c.encode()).hexdigest()


def test_notices_in_other_text(spark):
    line = min((t for _, t in KNOWN if "\n" not in t), key=len)
    name = {licenses.canonical(t): n for n, t in KNOWN}[licenses.canonical(line)]
    rows = [(1, f"Some prose first.\n{line}\nAnd more.", "en", "web"), (2, f"Prose that goes on {line}", "en", "web"), (3, line + " not", "en", "web")]
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    assert (got[1].license, got[1].notices, got[1].n_notices) == (None, name, 1)
    assert [(got[i].license, got[i].notices) for i in (2, 3)] == [(None, ""), (None, "")]


def test_no_python_in_the_plan(spark, edge):
    plan = licenses.scan(edge)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_edge_rows_and_sql(spark, edge, none, sf):
    got = licenses.scan(edge).collect()
    assert len(got) == len(EDGE)
    assert all((r.digest is None) == (r.doc_id == 2) and r.license is None and r.n_notices == 0 for r in got)
    assert licenses.scan(none).count() == 0
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(licenses.scan_sql()).fetchall())
    assert sorted(tuple(r) for r in licenses.scan(spark.read.parquet(f"{sf}/documents.parquet")).collect()) == want


def test_published_wrapping_and_known_texts_within_others(spark):
    texts = [(n, t) for n, t in KNOWN if "\n\n" in t]
    isc = dict(texts[::-1])["ISC"].replace("the above copyright notice", "the above\ncopyright notice")
    assert "\ncopyright notice" in isc
    bsd = dict(texts[::-1])["BSD-2-Clause"]
    rows = [(0, "Copyright (c) 2020 Some Body\n\n" + isc, "en", "web"), (1, "Some prose.\n\nCopyright 2020 Some Body\n\n" + isc + "\n\nMore prose.", "en", "web")]
    rows.append((2, bsd.replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS").replace("COPYRIGHT HOLDER OR", "\nCOPYRIGHT HOLDER OR").replace("COPYRIGHT OWNER", "\nCOPYRIGHT OWNER"), "en", "web"))
    rows += [(10 + i, f"First block.\n\n{t}\n\n\nLast block.", "en", "web") for i, (_, t) in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    assert (got[0].license, got[2].license) == ("ISC", "BSD-2-Clause")
    assert (got[1].license, got[1].notices) == (None, "ISC")
    for i, (name, _) in enumerate(texts):
        assert name in got[10 + i].notices.split(","), name


def refilled(text, width):
    """Every paragraph filled anew; on one line if there is no width."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    return "\n\n".join(textwrap.fill(p, width) if width else p for p in paragraphs)


@pytest.mark.parametrize("width", [50, 60, 72, 100, None])
def test_known_texts_at_any_width(spark, width):
    """Wherever lines break, as whole texts and within others; the least change of a sentence is another text."""
    rows = [(i, refilled(t, width), "en", "web") for i, (_, t) in enumerate(KNOWN)]
    rows += [(1000 + i, f"Prose, first.\n\n{refilled(t, width)}\n\nProse, last.", "en", "web") for i, (_, t) in enumerate(KNOWN)]
    names = {licenses.canonical(t): n for n, t in KNOWN}
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    for i, (name, text) in enumerate(KNOWN):
        assert got[i].license == names[licenses.canonical(text)], (name, width)
        assert names[licenses.canonical(text)] in got[1000 + i].notices.split(","), (name, width)


@pytest.mark.parametrize(
    ("known", "old", "new"),
    [("Apache-2.0", "copyright license to reproduce", "copyright license to sell"), ("Apache-2.0", "(c) You must retain", "(c) You may retain"), ("MPL-2.0", "(c) under Patent Claims", "(c) under no Patent Claims"), ("GPL-3.0", "also means copyright-like", "never means copyright-like"), ("LGPL-2.1", "copyrighted by the Free Software", "copyrighted by no Free Software")],
)
def test_altered_sentences_are_other_texts(known, old, new):
    text = next(t for n, t in KNOWN if n.startswith(known) and len(t) > 5000)
    flat = re.sub(r"\s+", " ", text)
    assert old in flat, (known, old)
    assert licenses.canonical(flat.replace(old, new)) != licenses.canonical(flat)


STATED = [
    ("Copyright (c) 2020 Some Body", True), ("Copyright 2019-2021, 2023 Foo Inc. <a@b.c>\nCopyright © 2024 Bar and others", True), ("(c) 1999 john doe", True), ("© 2001 The Regents\nof the University\nAll rights reserved.", True),
    ("Copyright (C) <year> <name of author>", True), ("the copyright holders state nothing", False), ("(c) retain this", False), ("copyright law of 1976", False),
]


@pytest.mark.parametrize(("lines", "goes"), STATED)
def test_what_states_a_copyright(spark, lines, goes):
    for between in ("\n", "\n\n", " "):
        text = f"{lines}{between}Permission is hereby granted"
        c = licenses.canonical(text)
        assert (c == "permission is hereby granted") == goes, text
        assert licenses.scan(table(spark, [(1, text, "en", "w")])).first().digest == hashlib.sha256(c.encode()).hexdigest()
