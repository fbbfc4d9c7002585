"""Encoding of whole texts with a public byte-level BPE, piece by piece from a cache.

A byte-level BPE of this family never lets a token reach over a single space between two other characters: the space
starts the next token. So a text is cut before each such space, a piece seen before costs one look-up, and a new piece
is split by the tokenizer's own pre-tokenisation, whose parts the tokenizers library's model encodes. The ids put
together are those of encoding the whole text at once; tests hold them against that. A text that holds the content of
one of the tokenizer's added tokens, such as <|endoftext|>, goes through the library's own encode.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Entries that a Python worker keeps of either kind, and the longest text kept. A full cache takes no more until it
#: has been missed 16 times as often as it has entries; then it starts anew. What is not kept is encoded again.
CACHE_PIECES, CACHE_WORDS, CACHE_CHARS = 400_000, 500_000, 40
#: The published pre-tokenisation of this family, and the characters that stand for bytes in its vocabulary.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_CHARS = {b: chr(b) for b in _SELF} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in set(_SELF))}


class Encoder:
    """ids(text) as uint32; spans(text) also gives each token's first code point and the one after its last."""

    def __init__(self, spec: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model, self.parts = self.tokenizer.model, regex.compile(_PARTS)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.missed = [0, 0]
        self.widths: np.ndarray | None = None

    def _keep(self, kind: int, cache: dict, most: int, key: str, value: bytes) -> None:
        if len(key) > CACHE_CHARS:
            return
        if len(cache) >= most:
            self.missed[kind] += 1
            if self.missed[kind] < 16 * most:
                return
            cache.clear()
            self.missed[kind] = 0
        cache[key] = value

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            as_bytes = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_AS_CHARS)
            found = np.array([t.id for t in self.model.tokenize(as_bytes)], dtype="<u4").tobytes()
            self._keep(1, self.words, CACHE_WORDS, word, found)
        return found

    def ids(self, text: str | None) -> np.ndarray:
        """Pieces begin with their space, which is left out of the cache's keys."""
        if not text:
            return np.zeros(0, dtype="<u4")
        if any(content in text for content in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        first, *pieces = text.split(" ")
        found = list(map(self.pieces.get, pieces))
        if None in found:
            for i, f in enumerate(found):
                if f is None:
                    piece = pieces[i]
                    if not piece or piece[0].isspace() or piece[-1].isspace():
                        return self._spaced(text)
                    get = self.words.get
                    found[i] = b"".join([get(w) or self._word(w) for w in self.parts.findall(" " + piece)])
                    self._keep(0, self.pieces, CACHE_PIECES, piece, found[i])
        if first and not first[-1].isspace():
            found.insert(0, b"".join(map(self._word, self.parts.findall(first))))
        elif first or pieces:
            return self._spaced(text)
        return np.frombuffer(b"".join(found), dtype="<u4")

    def _spaced(self, text: str) -> np.ndarray:
        """Where other white space touches a space, the text is cut by the pattern alone."""
        return np.frombuffer(b"".join(map(self._word, self.parts.findall(text))), dtype="<u4")

    def spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A token's bytes are as many as its vocabulary entry has characters, or an added token's content has bytes; they lead to its code points."""
        ids = self.ids(text)
        if not len(ids):
            return ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.widths is None:
            vocabulary = self.tokenizer.get_vocab()
            self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.widths[i] = len(token.encode()) if token in self.added else len(token)
        ends = np.cumsum(self.widths[ids])
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        point = np.cumsum((raw & 0xC0) != 0x80) - 1
        return ids, point[np.concatenate([[0], ends[:-1]])], point[ends - 1] + 1


@lru_cache(maxsize=1)
def encoder(spec: str) -> Encoder:
    """One encoder per Python worker; its cache serves all tasks that the worker runs."""
    return Encoder(spec)


def load_spec(path: str) -> str:
    """The tokenizer's JSON, read where the query is built; executors get it by broadcast (1.5 MB, fixed)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
