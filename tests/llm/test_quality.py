from __future__ import annotations

import zlib

import numpy as np

from lodegraph.llm import quality

from .conftest import EDGE, rows_of, table


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_ranking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    got = quality.score(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert auc(np.array([r.score for r in held]), np.array([truth[r.doc_id] for r in held])) > 0.9


def test_identity_equals_all_pairs():
    r = np.random.default_rng(0)
    m = quality.FactorMachine()
    m.w = r.normal(0, 1, len(m.w))
    m.v = r.normal(0, 1, m.v.shape)
    cols, vals = np.sort(r.choice(len(m.w), 12, replace=False)), r.normal(0, 1, 12)
    want = m.w[cols] @ vals + sum(m.v[cols[i]] @ m.v[cols[j]] * vals[i] * vals[j] for i in range(12) for j in range(i))
    assert np.isclose(m.raw(cols, vals, np.array([0]))[0][0], want)


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality", "toxic")
    first = rows_of(quality.score(docs, labels))
    assert first == rows_of(quality.score(docs, labels)) == rows_of(quality.score(docs, flipped))


def test_edge_rows(spark, edge, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (5, 0, 0), (7, 1, 1), (8, 0, None), (None, 1, 0), (6, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(edge, labels).collect()
    assert len(got) == len(EDGE)
    assert all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id in (1, 7)]
    assert len(set(same)) == 1
    assert quality.score(none, labels).count() == 0
    unlabelled = quality.score(edge, labels.where("quality = 1")).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_sample_is_bounded_by_ids(spark, monkeypatch):
    """An id that thousands of rows share gives one row to learn from."""
    seen = []
    monkeypatch.setattr(quality.FactorMachine, "fit", lambda self, made, y: seen.append(len(y)) or self)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(ids[0], f"text {i} of many", "en", "w") for i in range(3000)] + [(i, f"another text {i}", "en", "w") for i in ids[1:]]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    quality.train(table(spark, rows), labels)
    assert seen == [len(ids)]
