from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000
#: Rows that every operator must bear: nulls in each column, empty and white texts, a long text, ties, repeated rows.
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog by the river bank today.", "en", "web"),
    (1, "The quick brown fox jumps over the lazy dog by the river bank today.", "en", "web"),
    (2, None, None, None),
    (3, "", "en", "web"),
    (4, " \t\n\x0b ", "de", None),
    (5, LONG, None, "books"),
    (None, "A row without an id, which stays a row.", "en", "web"),
    (6, "Grüße, 你好 👋   ünïcode text é 12345", "de", "books"),
    (7, "The quick brown fox jumps over the lazy dog by the river bank today.", "en", "web"),
    (8, "12345 !!! ???", None, "web"),
]
#: Names that operators use for working columns.
CLASHING = ["n_words", "size", "fp", "first", "words", "_id", "_h", "_text_hash", "bad", "tag", "component", "score", "target", "kept"]


def table(spark, rows, clashing=False):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    if clashing:
        schema += "".join(f", {c} string" for c in CLASHING)
        rows = [(*r, *[f"own {c}" for c in CLASHING]) for r in rows]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def edge(spark):
    return table(spark, EDGE, clashing=True).cache()


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [], clashing=True)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows_of(df):
    """Rows as tuples, nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])
