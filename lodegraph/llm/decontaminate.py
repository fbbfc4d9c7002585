"""Operator 7: benchmark decontamination by suffix arrays over shards of the training text.

Every task is a shard: it turns its documents into one sequence of word numbers, builds a suffix array over it by
prefix doubling, and binary-searches every suffix of the benchmark in it. A search gives the run of corpus suffixes
that share at least a window's words with the item's suffix, hence all places of every window, and the longest
verbatim match of each document. Words that no item has get number 0, which matches nothing.

The benchmark is the stated query set: it is read in blocks of at most `block_bytes` characters of text, dealt by the
hash of the item id, and each block is broadcast (the bound is a parameter) and searched in one pass over the corpus.
The places of a window in the items are kept in the order of what follows them, so that the longest match at a place
is found by binary search among them, however many items share the window or one item repeats it. Matches of equal
length name the least item. A block takes memory in proportion to its words.

Edge cases: null or wordless texts have no words, are never hit, and a wordless item never occurs; a null item_id is
listed as an empty string; repeated items count once by item_id; repeated documents each get their row; an empty
benchmark or corpus gives no hits or no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Words of corpus per suffix array: bounds a task's memory; a document is never cut.
SHARD_WORDS = 1 << 19
SPANS = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
MATCHES = "doc_id long, h long, n_words long, hits array<struct<a:int,z:int>>, items array<string>, longest int, longest_item string, longest_at int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(_UPPER)) if text else []


class Queries:
    """A block of the benchmark: its words by number in one sequence, and the places of every distinct window in it.

    A row of the benchmark is known by the place of its first word; so nothing is kept twice, however long an item is,
    and rows that repeat an item_id with another text are rows of their own.
    """

    def numbers(self, text: str | None) -> np.ndarray:
        """The words of a text by number; 0 for those that no item has."""
        words, get = words_of(text), self.number.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.window, self.number = window, {}
        parts, names = [], []
        for item, text in items:
            if w := words_of(text):
                parts.append(np.array([*(self.number.setdefault(x, len(self.number) + 1) for x in w), 0], np.int64))
                names.append(item)
        self.names = np.array(names, object)
        self.seq = np.concatenate(parts) if parts else np.zeros(1, np.int64)
        size = np.array([len(p) for p in parts], np.int64)
        self.of = np.repeat(np.arange(len(parts)), size)
        self.end = np.repeat(np.cumsum(size) - 1, size)
        left = self.end - np.arange(len(self.of))
        # a place begins a window if a whole one follows, or if it begins an item that is shorter
        first = np.zeros(len(self.of), bool)
        first[np.cumsum(size) - size] = True
        at = np.flatnonzero((left >= window) | (first & (left > 0)))
        rows = np.zeros((len(at), window), np.int64)
        for j in range(window):
            use = left[at] > j
            rows[use, j] = self.seq[at[use] + j]
        self.rows, which = np.unique(rows, axis=0, return_inverse=True) if len(at) else (rows, np.zeros(0, np.int64))
        self.lengths = (self.rows > 0).sum(1)
        rank = suffix_ranks(self.seq)
        order = np.lexsort((rank[at], which.ravel()))
        self.places = at[order]
        self.bounds = np.searchsorted(which.ravel()[order], np.arange(len(self.rows) + 1))
        self.most = np.maximum.reduceat(left[self.places], self.bounds[:-1]) if len(at) else np.zeros(0, np.int64)

    def items(self, w: int) -> set[str]:
        return set(self.names[self.of[self.places[self.bounds[w] : self.bounds[w + 1]]]])

    def longest(self, w: int, words: np.ndarray) -> tuple[int, str]:
        """The greatest number of words that follow any place of window w as they stand in words, and the least item that has them."""
        places = self.places[self.bounds[w] : self.bounds[w + 1]]
        low, high = 0, len(places)
        while low < high:
            mid = (low + high) // 2
            k = self.common(places[mid], words)
            p = places[mid] + k
            # an item that ends here, or goes on with a lesser word, stands before the words
            if k < len(words) and (p >= self.end[places[mid]] or self.seq[p] < words[k]):
                low = mid + 1
            else:
                high = mid
        n = max(self.common(p, words) for p in places[max(low - 1, 0) : low + 1])
        # those that share n words stand next to each other around the place found: the common prefix only falls away from it
        shares = lambda i: self.common(places[i], words[:n]) == n
        first = bisect_left(range(low), True, key=shares)
        last = low + bisect_left(range(low, len(places)), True, key=lambda i: not shares(i))
        return n, min(self.names[np.unique(self.of[places[first:last]])])

    def common(self, place: int, words: np.ndarray) -> int:
        """The length of the common prefix of words and of the item from a place on; compared in growing steps."""
        most, done, step = min(self.end[place] - place, len(words)), 0, 32
        while done < most:
            z = min(done + step, most)
            differ = self.seq[place + done : place + z] != words[done:z]
            if differ.any():
                return done + int(differ.argmax())
            done, step = z, 2 * step
        return int(most)


def suffix_ranks(seq: np.ndarray) -> np.ndarray:
    """The rank of each suffix of seq up to its first 0: prefix doubling until all differ, or none is longer."""
    rank, done = seq.copy(), 1
    longest = int(np.diff(np.concatenate([[-1], np.flatnonzero(seq == 0)])).max())
    while done < longest:
        nxt = np.zeros_like(rank)
        nxt[:-done] = rank[done:]
        nxt[rank == 0] = 0
        key = rank * (int(nxt.max()) + 1) + nxt
        key[seq == 0] = 0
        found, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + (0 if found[0] == 0 else 1)
        if len(found) == len(seq) - (seq == 0).sum() + 1:
            break
        done *= 2
    return rank


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """The starts of seq's suffixes without number 0 at their head, sorted by their first `depth` numbers at least.

    Prefix doubling; seq ends in a 0, and what follows a 0 does not count.
    """
    rank = np.where(seq > 0, seq, 0)
    done = 1
    while done < depth:
        nxt = np.zeros_like(rank)
        nxt[:-done] = rank[done:]
        nxt[rank == 0] = 0
        key = rank * (int(nxt.max()) + 1) + nxt
        key[seq == 0] = 0
        live = np.flatnonzero(key)
        _, small = np.unique(key[live], return_inverse=True)
        rank = np.zeros_like(rank)
        rank[live] = small + 1
        done *= 2
    live = np.flatnonzero(seq)
    return live[np.argsort(rank[live], kind="stable")]


def search(seq: np.ndarray, sa: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its run lo..hi of suffixes in sa that start with it: binary searches, all rows at once."""

    def bound(right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(sa), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = sa[np.minimum(mid, len(sa) - 1)]
            less, tied = np.zeros(len(rows), bool), open_.copy()
            for j in range(rows.shape[1]):
                use = tied & (j < lengths)
                if not use.any():
                    break
                have = seq[np.minimum(at + j, len(seq) - 1)]
                less |= use & (have < rows[:, j])
                tied &= ~use | (have == rows[:, j])
            # a suffix that starts with the row counts as below it when the right end is sought
            go = less | (tied & right)
            lo = np.where(open_ & go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    return bound(False), bound(True)


def _matches(docs: list[tuple], q: Queries) -> Iterator[tuple]:
    """MATCHES for one shard of (row's own columns, word numbers); hits are the stretches of hit words."""
    numbered = [n for _, n in docs]
    seq = np.concatenate([x for n in numbered for x in (n, np.zeros(1, np.int64))])
    begins = np.concatenate([[0], np.cumsum([len(n) + 1 for n in numbered])])
    places: dict[int, list] = {}
    if len(q.rows) and seq.any():
        # stretches of known words shorter than every window can't match; they need no suffixes
        edge = np.flatnonzero(seq == 0)
        run = np.diff(np.concatenate([[-1], edge])) - 1
        short = np.repeat(run < q.lengths.min(), run + 1)
        seq = np.where(short, 0, seq)
        sa = suffix_array(seq, q.window)
        if len(sa):
            lo, hi = search(seq, sa, q.rows, q.lengths)
            for w in np.flatnonzero(hi > lo):
                for at in sa[lo[w] : hi[w]]:
                    d = int(np.searchsorted(begins, at, "right")) - 1
                    places.setdefault(d, []).append((int(at - begins[d]), int(w)))
    for d, (row, ws) in enumerate(docs):
        hits, items, best = [], set(), (0, None, None)
        for w in {w for _, w in places.get(d, ())}:
            items.update(q.items(w))
        for at, w in sorted(places.get(d, ())):
            end = at + int(q.lengths[w])
            if hits and at <= hits[-1]["z"]:
                hits[-1]["z"] = max(hits[-1]["z"], end)
            else:
                hits.append({"a": at, "z": end})
            if q.most[w] > best[0]:
                n, item = q.longest(w, numbered[d][at : at + int(q.most[w])])
                if n > best[0]:
                    best = (n, item, at)
        yield *row, len(ws), hits, sorted(items), best[0], best[1], best[2]


def find_matches(docs: DataFrame, items: list[tuple[str, str | None]], window: int = 10) -> DataFrame:
    """MATCHES per row of docs (doc_id, text), for one block of items; h is the text's hash."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Queries(sent.value, window)
        kinds = [pa.int64(), pa.int64(), pa.int64(), SPANS, pa.list_(pa.string()), pa.int32(), pa.string(), pa.int32()]
        names = [c.split()[0] for c in MATCHES.split(", ")]

        def flush(held: list) -> pa.RecordBatch:
            columns = list(zip(*_matches(held, q), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        held, n = [], 0
        for batch in batches:
            for doc_id, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                held.append(((doc_id, h), q.numbers(text.as_py())))
                n += len(held[-1][1])
                if n >= SHARD_WORDS:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, MATCHES)
    out._lodegraph_sent = sent  # released when a block is done
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, str | None]]]]:
    """The number of blocks of about block_bytes characters, and the blocks of (item_id as text, text), read one at a time."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where(F.col("text").isNotNull())
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // block_bytes) or 1
    return parts, ([(r["item"], r["text"]) for r in b.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p).collect()] for p in range(parts))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest match and its place.

    With one block (the usual case) each document is scanned once and nothing is shuffled. With more, each block is
    one scan whose matches are written before the next; only rows with matches are merged, by id and text, and over
    blocks their stretches may overlap.
    """
    parts, blocks = benchmark_blocks(benchmark, block_bytes)
    if parts == 1:
        found = find_matches(docs, next(blocks), window)
    else:
        found = _merged(docs, blocks, window)
    return found.select("doc_id", "n_words", _covered("hits").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "items", "longest", "longest_item", "longest_at")


def _merged(docs: DataFrame, blocks: Iterator[list], window: int) -> DataFrame:
    """MATCHES per row of docs over all blocks. Rows that repeat id and text have equal matches in each."""
    from . import common

    rows, tables = None, []
    for items in blocks:
        found = find_matches(docs, items, window)
        if rows is None:
            rows = common.written(found, "matches")
            tables.append(rows.where("size(hits) > 0"))
        else:
            tables.append(common.written(found.where("size(hits) > 0"), "matches"))
        found._lodegraph_sent.unpersist()
    every = reduce(DataFrame.unionByName, tables)
    best = F.min(F.struct((-F.col("longest")).alias("n"), "longest_item", "longest_at"))
    hits, items = F.flatten(F.collect_set("hits")), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    merged = every.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(hits.alias("hits"), items.alias("items"), best.alias("b"))
    none = rows.select("doc_id", "h", "n_words").join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return none.select("doc_id", "h", "n_words", empty("hits", "array<struct<a:int,z:int>>"), empty("items", "array<string>"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("longest"), F.col("b.longest_item").alias("longest_item"), F.col("b.longest_at").alias("longest_at"))


def _covered(hits: str):
    """Words in the union of the stretches of `hits`."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0), p["z"] - F.greatest(p["a"], s["end"]))).cast("long").alias("n"), F.greatest(s["end"], p["z"]).alias("end"))
    return F.aggregate(F.array_sort(hits), start, step)["n"]


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text holds a window of the benchmark; every row of such a doc_id goes."""
    from . import common

    name = common.fresh(docs, "bad")
    bad = common.written(decontaminate(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
