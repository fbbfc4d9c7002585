from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import token_output
from lodegraph.llm.tokenize import encoder, load_spec

from .conftest import EDGE, rows_of, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(library, rows):
    """The contract by brute force: texts in id order, ids of the library, the end id, running starts."""
    out, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_library_on_any_text(text):
    e = encoder(load_spec(PATH))
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert e.ids(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "\n\n a\t b", "it's we'll", "a  b", "x " * 9, "  ", "don 't", "1 2,3", "é é", "a \n b", "  a", "A" * 5000])
def test_encoder_equals_library(text):
    e = encoder(load_spec(PATH))
    assert e.ids(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 20, 32])
def test_pack_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_001, dtype=np.uint64).astype(np.uint32)
    payload = token_output.pack(ids, bits)
    assert len(payload) == -(-len(ids) * bits // 8)
    for a, b in ((0, len(ids)), (3, 4), (65_530, 65_545), (70_000, 70_001), (9, 9)):
        assert np.array_equal(token_output.unpack(payload, bits, a, b), ids[a:b])


def test_bits_are_the_fewest():
    assert [token_output.bits_for(v) for v in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


def test_query_against_library(spark, library, tmp_path):
    rows = [(i * 3 % 101, f"document {i} says   it's {i * i} \n times {'w' * (i % 7)}" if i % 9 else None, "en", "web") for i in range(101)]
    blocks = token_output.write_blocks(table(spark, rows), str(tmp_path / "t"), tokenizer_path=PATH, end_id=2, shards=3, block_tokens=64)
    index = token_output.document_index(blocks)
    assert rows_of(index.select("doc_id", "start", "n_tokens", "ids_crc32")) == expected(library, rows)
    # random access: the ids of one document from its block alone
    place = index.where("doc_id = 50").first()
    block = blocks.where(f"shard = {place.shard} and block = {place.block}").first()
    text = next(r[1] for r in rows if r[0] == 50)
    got = token_output.unpack(block.payload, block.bits, place["first"], place["first"] + place.n_tokens)
    assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_edge_rows(spark, edge, none, library):
    got = token_output.token_output(edge, tokenizer_path=PATH, end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert rows_of(got) == expected(library, EDGE)
    assert token_output.token_output(none, tokenizer_path=PATH, end_id=2).count() == 0


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z <|endoftext|>\n", "é <|endoftext|><|endoftext|> 你好", "<|endoftext| >"]


@pytest.mark.parametrize("text", ADDED)
def test_added_tokens_equal_library(text):
    e = encoder(load_spec(PATH))
    want = e.tokenizer.encode(text, add_special_tokens=False)
    assert e.ids(text).tolist() == want.ids
    ids, begin, end = e.spans(text)
    assert [text[a:b] for a, b, i in zip(begin.tolist(), end.tolist(), ids.tolist(), strict=True) if i == 50256] == ["<|endoftext|>"] * want.ids.count(50256)
    assert (begin[0], end[-1]) == (0, len(text))


def test_added_tokens_through_the_query(spark, library):
    rows = [(i, t, "en", "web") for i, t in enumerate(ADDED)]
    got = token_output.token_output(table(spark, rows), tokenizer_path=PATH, end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert rows_of(got) == expected(library, rows)
