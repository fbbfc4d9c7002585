from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from lodegraph.llm import token_counts
from lodegraph.llm.tokenize import encoder, load_spec

from .conftest import EDGE, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(text, sections, rule):
    """Tokens per section, from the library's own offsets, one token at a time."""
    counts = {i: 0 for i in range(-1, len(sections))}
    for a, b in encoder(load_spec(PATH)).tokenizer.encode(text, add_special_tokens=False).offsets:
        touched = [i for i, (x, y) in enumerate(sections) if min(b, y) > max(a, x)]
        if not touched:
            counts[-1] += 1
        elif rule == "largest":
            counts[max(touched, key=lambda i: (min(b, sections[i][1]) - max(a, sections[i][0]), -i))] += 1
        else:
            counts[touched[0 if rule == "start" else -1]] += 1
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_against_brute_force(spark, rule):
    r = np.random.default_rng(4)
    texts = ["The internationalisation of counterrevolutionaries is straightforward.", "naïve café – 你好 wörld", "short"]
    rows = []
    for i, text in enumerate(texts):
        cuts = sorted(r.choice(np.arange(len(text) + 1), min(4, len(text)), replace=False).tolist())
        rows.append((i, text, [(f"s{k}", a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if k != 1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<name:string,begin:long,end:long>>")
    got = token_counts.token_counts(docs, tokenizer_path=PATH, sections="parts", rule=rule).collect()
    for doc_id, text, parts in rows:
        want = brute(text, [(a, b) for _, a, b in parts], rule)
        assert {r.section: r.n_tokens for r in got if r.doc_id == doc_id} == {k: v for k, v in want.items() if k >= 0 or v}


def test_lines_cover_every_token(spark, edge, none):
    got = token_counts.token_counts(edge, tokenizer_path=PATH, rule="largest")
    sums = {(r.doc_id, r.doc_tokens): r.n for r in got.groupBy("doc_id", "doc_tokens").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    encode = encoder(load_spec(PATH)).tokenizer.encode
    for doc_id, text, *_ in EDGE:
        n = len(encode(text or "", add_special_tokens=False).ids)
        assert sums[(doc_id, n)] == n * sum(r[0] == doc_id for r in EDGE)
    assert token_counts.token_counts(none, tokenizer_path=PATH).count() == 0


def test_null_sections_and_unknown_rule(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, parts array<struct<name:string,begin:long,end:long>>")
    assert [(r.section, r.n_tokens) for r in token_counts.token_counts(docs, tokenizer_path=PATH, sections="parts").collect()] == [(-1, 2)]
    with pytest.raises(ValueError, match="rule"):
        token_counts.token_counts(table(spark, []), tokenizer_path=PATH, rule="middle")
