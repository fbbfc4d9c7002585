from __future__ import annotations

import zlib

import numpy as np
import pytest

from lodegraph.llm import langid

from .conftest import EDGE, rows_of, table


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, documents):
    truth = {r.doc_id: r.lang for r in documents.where("lang is not null and length(text) > 40").select("doc_id", "lang").collect()}
    got = langid.identify(documents).collect()
    assert len(got) == documents.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_labels_of_the_held_out_and_other_columns_do_not_matter(spark, documents):
    from pyspark.sql import functions as F

    some = documents.where("doc_id < 400")
    changed = some.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    first = rows_of(langid.identify(some))
    assert first == rows_of(langid.identify(some))
    assert first == rows_of(langid.identify(changed))


def test_tables_score_as_the_network_does():
    model = langid.ByteCnn(["a", "b", "c"])
    x = np.random.default_rng(0).integers(0, 256, (9, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(model._forward(x)[0], model.windows(x, model.tables()), atol=1e-4)


def test_training_follows_its_gradient():
    r = np.random.default_rng(0)
    x = np.concatenate([r.integers(97, 110, (200, 128)), r.integers(105, 123, (200, 128))]).astype(np.uint8)
    y = np.repeat([0, 1], 200)
    model = langid.ByteCnn(["a", "b"]).fit(x, y, epochs=6)
    assert (model.windows(x, model.tables()).argmax(1) == y).mean() > 0.98


def test_windows_hold_the_whole_text():
    for n in (1, 127, 128, 129, 1000):
        x, size = langid.cut("é" * n)
        assert bytes(x.ravel()[: 2 * n]).decode() == "é" * n
        assert size.sum() == 2 * n
        assert len(x) == -(-2 * n // 128)


def test_edge_rows(spark, edge, none):
    got = langid.identify(edge).collect()
    assert len(got) == len(EDGE)
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 4, 8))
        assert r.lang_pred in ("und", "en", "de")
    kept = langid.in_a_language(edge, least=0.0)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} == {None, 1, 5, 6, 7}
    assert langid.identify(none).count() == 0
    unlabelled = table(spark, [(1, "some text", None, "web")])
    assert [(r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]
    assert langid.in_a_language(none).count() == 0


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    """An id that thousands of rows share is neither taken whole nor left out."""
    seen = []
    monkeypatch.setattr(langid.ByteCnn, "fit", lambda self, x, y, epochs: seen.append(len(x)) or self)
    for one in (1, 2, 4, 11):
        rows = [(one, f"text number {i} of many rows with one id", "en", "w") for i in range(3000)] + [(one, "the same text in every row", "de", "w")] * 2000
        langid.train(table(spark, rows), per_language=50, windows_per_doc=1)
    assert len(seen) >= 2 and set(seen) == {51}


def test_numerals_are_no_letters(spark, documents):
    rows = [(1, "\u00bd \u00b2 \u2167 \u2460 12", "en", "w"), (2, "\u00bd cup of flour", "en", "w"), (3, "\u6f22", "en", "w")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(table(spark, rows).unionByName(documents.where("doc_id > 100 and doc_id < 500").select("doc_id", "text", "lang", "source", "n_chars"))).collect()}
    assert got[1] == "und" and got[2] != "und" and got[3] != "und"
