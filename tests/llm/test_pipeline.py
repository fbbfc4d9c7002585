from __future__ import annotations

import public_tokenizers
import pytest

from .conftest import EDGE, rows_of
from .test_decontaminate import brute as hits
from .test_near_copies import kept_by_brute_force
from .test_token_output import expected

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {"documents": docs}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.common.written(stage(spark, now, sf), f"test-{name}")
        kept[name] = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    texts = {n: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for n, d in kept.items() if "text" in d.columns}
    langs = texts["language_id"]
    assert set(langs) <= set(texts["documents"])
    assert len(langs) > 0.9 * len(texts["documents"])
    # five-word shingles, Jaccard similarity 0.8 or more, all pairs
    assert sorted(d for d, _ in texts["simhash_near_dedup"]) == kept_by_brute_force(langs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r[0] for r in hits(texts["simhash_near_dedup"], items) if r[5]}
    assert dirty
    assert sorted(d for d, _ in texts["benchmark_decontamination"]) == sorted({d for d, _ in texts["simhash_near_dedup"]} - dirty)
    mixed = texts["source_mixing"]
    assert {d for d, _ in mixed} <= {d for d, _ in texts["benchmark_decontamination"]}
    size = lambda rows: sum(len(t.split()) for _, t in rows)
    assert abs(size(mixed) / size(texts["benchmark_decontamination"]) - 1.5) < 0.05
    # rows that share a doc_id stand next to each other; starts follow from all ids before
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {(d, len(library.encode(t, add_special_tokens=False).ids) + 1) for d, t in mixed}
    got = kept["token_output"].orderBy("start").collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == n
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    single = [r for r in mixed if [d for d, _ in mixed].count(r[0]) == 1]
    crc = {(d, c) for d, _, _, c in expected(library, single)}
    assert crc <= {(r.doc_id, r.ids_crc32) for r in got}


def test_every_stage_bears_edge_rows(spark, edge, none, sf):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, sf)
        assert out.count() <= 2 * len(EDGE)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == edge.columns
        assert stage(spark, none, sf).count() == 0


def test_run_repeats_itself(spark, sf):
    assert rows_of(corpus_pipeline.run(spark, sf)) == rows_of(corpus_pipeline.run(spark, sf))
