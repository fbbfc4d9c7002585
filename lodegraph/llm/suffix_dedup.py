"""Operator 3: removal of every byte that a string of `length` bytes, seen earlier in the corpus, covers.

The suffixes of a collection are sorted column by column: each round every string gives one symbol, and the order and
the common prefixes of neighbours are updated from those of the round before. Over whole documents that takes as many
rounds as the longest has bytes, each over all data, which no cluster can do in time; so only the short stretches that
can hold a repeat are collected, and the rounds are at most 2 * length:

1. Anchors. Of each window of `length` bytes the least hashed 32-byte string in it, the leftmost of equals, is its
   anchor. Equal windows have equal anchors at equal places. Successive windows with one anchor make a run of at most
   length - 31 windows. A run is a row (anchor, digest of its bytes, doc_id, place): about one per 35 bytes.
2. Runs whose anchor occurs once in the corpus hold no repeat and go. Of runs with equal digests the first stays and
   the others are removed whole, as equal strings enter the collection once. Both are counts and minima. A task sends
   one row per different run of 16 MB of text, and of an anchor with one run there one row, so what one key gathers is
   one row per 16 MB of corpus at most.
3. First runs that share an anchor with others differ somewhere. Their bytes (at most 2 * length - 32) are collected
   by anchor, and their suffixes sorted by columns: equal windows become neighbours with a common prefix of `length`.
   The collection of an anchor with more than `most_runs` runs is split so that it fits tasks: the places that the
   anchor can have in a window are halved, and the runs of one half go on under a longer anchor, the bytes that all its
   windows have in common. Halving ends with single places, where the longer anchor is the window; a run makes two
   rows or three in a halving. Equal windows always stay together, so the same columns are sorted in smaller groups.
4. The spans of a document are merged, and its text is cut.

The tables written between these steps are the external files, read in order of anchor. Digests of step 2 are 64 bits
beside a 64-bit anchor of other origin; all later comparisons are of bytes. Starts are compared as (doc_id, start),
null first. `length` is 33 to 1054. Edge cases: null text counts as empty; rows that repeat a doc_id are the same
document, in which equal starts are not earlier than each other, so that repeated rows get equal results; texts below
`length` bytes stay whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

GRAM = 32
#: Bytes of text hashed at once, and bytes whose runs are reduced together before they are sent.
BLOCK, REDUCE = (1 << 20) - 1, 16 << 20
#: Distinct runs of an anchor up to which they are sorted in one task; beyond, they are split by longer anchors.
MOST_RUNS = 1000
#: Bytes of collected runs sorted at once in a task.
SORT_BYTES = 8 << 20
_MASK = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_NONE = np.iinfo(np.int64).min


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2**64."""
    step = lambda base: np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]).cumprod(dtype=np.uint64)
    return step(_BASE), step(pow(_BASE, -1, 1 << 64))


class Anchors:
    """Runs of windows by their anchors, for texts laid end to end in blocks."""

    def __init__(self, length: int) -> None:
        self.length, (self.up, self.down) = length, _powers(BLOCK + 1)

    def runs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """First window, number of windows, anchor and its offset of each run in data; windows lie within texts that end at ends."""
        n, length = len(data), self.length
        none = np.zeros(0, np.int64)
        if n < length:
            return none, none, none.astype(np.uint64), none
        with np.errstate(over="ignore"):
            h = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], dtype=np.uint64, out=h[1:])
            g = (h[GRAM:] - h[:-GRAM]) * self.down[: n - GRAM + 1]
            g ^= g >> np.uint64(32)
            g *= np.uint64(0xD6E8FEB86659FD93)
            g ^= g >> np.uint64(32)
            g *= np.uint64(0xD6E8FEB86659FD93)
            g ^= g >> np.uint64(32)
        m = (g & ~_MASK) | np.arange(len(g), dtype=np.uint64)
        width = length - GRAM + 1
        size = 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < width:
            m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
        at = (m & _MASK).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        valid = np.zeros(len(at) + 1, np.int64)
        last = ends - length + 1
        ok = last > starts
        np.add.at(valid, starts[ok], 1)
        np.add.at(valid, np.minimum(last[ok], len(at)), -1)
        inside = np.cumsum(valid)[:-1] > 0
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
        new[starts[ok]] = True
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(at)]]))
        keep = inside[first]
        first, count = first[keep], count[keep]
        return first, count, g[at[first]], at[first] - first


#: kind holds the anchor's offset in the run times 4, and 0: a run whose anchor must be counted; 1: one whose anchor is known to recur; 2: a mark of such an anchor, which counts twice; 3: a span to remove.
TAG_BITS, COUNT_BITS = 21, 10
RUNS = "kind int, route long, anchor long, digest long, doc_id long, place long"


def place_of(tag, count, start):
    """TAG_BITS of the text's hash, COUNT_BITS of the run's windows, 32 bits of the start."""
    return (tag << (32 + COUNT_BITS)) | (count << 32) | start


def find_runs(docs: DataFrame, length: int) -> DataFrame:
    """RUNS of docs (doc_id, tag, text). Spans (kind 3) have their number of bytes in digest and the start in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        finder = Anchors(length)
        rows: list[tuple] = []  # (doc, tag, base, first, count, anchor, digest) per block
        held = 0
        block: list[tuple[int, int, int, bytes]] = []
        size = 0

        def hash_block() -> None:
            nonlocal size
            raw = b"".join(x[3] for x in block)
            ends = np.cumsum([len(x[3]) for x in block])
            first, count, anchor, offset = finder.runs(np.frombuffer(raw, np.uint8), ends)
            which = np.searchsorted(ends, first, "right")
            begin = np.concatenate([[0], ends[:-1]])
            docs_, tags, bases = (np.array([x[i] for x in block], np.int64) for i in range(3))
            digest = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)), np.uint64, len(first))
            rows.append((docs_[which], tags[which], first - begin[which] + bases[which], count, anchor.view(np.int64), digest.view(np.int64), offset))
            block.clear()
            size = 0

        def settle() -> Iterator[pa.RecordBatch]:
            """Of equal runs only the first is sent on; the others' bytes go for sure."""
            nonlocal held
            if not rows:
                return
            doc, tag, start, count, anchor, digest, offset = (np.concatenate(c) for c in zip(*rows, strict=True))
            rows.clear()
            held = 0
            order = np.lexsort((start, doc, digest, anchor))
            doc, tag, start, count, anchor, digest, offset = (x[order] for x in (doc, tag, start, count, anchor, digest, offset))
            same = np.zeros(len(doc), bool)
            same[1:] = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
            later = same & ((doc != doc[head]) | (start != start[head]))
            # spans: successive ones of a document are merged
            o = np.lexsort((start[later], tag[later], doc[later]))
            d, t, a, z = doc[later][o], tag[later][o], start[later][o], (start + count + length - 1)[later][o]
            if len(d):
                brk = np.ones(len(d), bool)
                brk[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (a[1:] > z[:-1])
                at = np.flatnonzero(brk)
                d, t, a, z = d[at], t[at], a[at], np.maximum.reduceat(z, at)
            yield batch_of(3, d, d * 0, z - a, d, place_of(t, 0, a))
            rest = ~later
            doc, tag, start, count, anchor, digest, offset = (x[rest] for x in (doc, tag, start, count, anchor, digest, offset))
            # an anchor of many different runs recurs for sure: its rows need not meet in one task to be counted
            _, inverse, number = np.unique(anchor, return_inverse=True, return_counts=True)
            sure = number[inverse] > 1
            yield batch_of(np.where(sure, 1, 0) + 4 * offset, np.where(sure, digest, anchor), anchor, digest, doc, place_of(tag, count, start))
            marks = np.unique(anchor[sure])
            yield batch_of(2, marks, marks, marks * 0, marks * 0, marks * 0)

        def batch_of(kind, route, anchor, digest, doc, place) -> pa.RecordBatch:
            kinds = np.broadcast_to(np.asarray(kind, np.int32), doc.shape)
            ids = pa.array(doc, pa.int64(), mask=doc == _NONE)
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), *(pa.array(x, pa.int64()) for x in (route, anchor, digest)), ids, pa.array(place, pa.int64())], names=[c.split()[0] for c in RUNS.split(", ")])

        for batch in batches:
            for doc_id, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for base in range(0, max(len(raw) - length + 1, 0), BLOCK - length + 1):
                    part = raw[base : base + BLOCK]
                    if size + len(part) > BLOCK:
                        hash_block()
                    block.append((_NONE if doc_id is None else doc_id, tag, base, part))
                    size += len(part)
                    held += len(part)
                if held >= REDUCE:
                    hash_block()
                    yield from settle()
        if block:
            hash_block()
        yield from settle()

    return docs.mapInArrow(run, RUNS)


def least_between(values: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least of values[p + 1 .. q] for each pair p < q: two overlapping stretches of a power of two."""
    level = np.frexp((q - p).astype(np.float64))[1] - 1
    out, table = np.empty(len(p), values.dtype), values
    for k in range(int(level.max()) + 1 if len(p) else 0):
        use = level == k
        if use.any():
            a, b = p[use] + 1, q[use]
            out[use] = np.minimum(table[a], table[b - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def equal_windows(pieces: list[bytes], counts: np.ndarray, anchors: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(piece, offset) of all windows that an equal window precedes; piece i has windows at offsets 0..counts[i]-1.

    Equal windows have their anchor at the same place, so with the pieces laid so that their anchors (at anchors[i])
    stand in one column, they begin in one column. Columns are taken from the right. Each round every piece that
    reaches the column gives one symbol; a stable sort by it turns the order of what stands to the right into the order
    of the suffixes from this column, and the common prefixes of neighbours follow from those of the round before: one
    more than the least between them, or 0 if their symbols differ.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    zero = np.cumsum(sizes) - sizes + anchors  # where column 0 is
    enters, leaves = sizes - anchors - 1, -anchors
    queue = np.argsort(-enters, kind="stable")
    entered = 0
    order = np.zeros(0, np.int64)
    prefix = np.zeros(0, np.int16)
    for column in range(int(enters.max()), int(leaves.min()) - 1, -1):
        until = int(np.searchsorted(-enters[queue], -column, "right"))
        fresh, entered = queue[entered:until], until
        order = np.concatenate([fresh, order])
        prefix = np.concatenate([np.zeros(len(fresh), np.int16), prefix])
        here = np.flatnonzero(leaves[order] <= column)
        transform = data[zero[order[here]] + column]
        to = np.argsort(transform, kind="stable")
        by, symbol = here[to], transform[to]
        common_ = np.zeros(len(by), np.int16)
        alike = np.flatnonzero(symbol[1:] == symbol[:-1])
        common_[alike + 1] = least_between(prefix, by[alike], by[alike + 1]) + 1
        order, prefix = order[by], common_
        long = prefix >= length
        if not long.any():
            continue
        member = long.copy()
        member[:-1] |= long[1:]
        m = np.flatnonzero(member)
        group, who = np.cumsum(~long[m]), order[m]
        offset = column + anchors[who]
        d, s = doc[who], start[who] + offset
        o = np.lexsort((s, d, group))
        head = np.ones(len(o), bool)
        head[1:] = group[o][1:] != group[o][:-1]
        lead = o[np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))]
        later = o[(d[o] != d[lead]) | (s[o] != s[lead])]
        yield who[later], offset[later]


SPANS = "doc_id long, tag long, a long, z long"


def sort_runs(runs: DataFrame, length: int) -> DataFrame:
    """SPANS of the windows of runs (anchor, doc_id, tag, start, n, bytes, at) that an equal window precedes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            counts = np.array([r[4] for r in rows], np.int64)
            doc = np.array([_NONE if r[1] is None else r[1] for r in rows], np.int64)
            start = np.array([r[3] for r in rows], np.int64)
            base = np.concatenate([[0], np.cumsum(counts)])
            hit = np.zeros(base[-1], bool)
            for piece, offset in equal_windows([r[5] for r in rows], counts, np.array([r[6] for r in rows], np.int64), doc, start, length):
                hit[base[piece] + offset] = True
            edge = np.zeros(len(hit) + 1, bool)
            edge[base[:-1]] = True
            on = hit & np.concatenate([[True], ~hit[:-1] | edge[1:-1]]) if len(hit) else hit
            off = hit & np.concatenate([~hit[1:] | edge[1:-1], [True]]) if len(hit) else hit
            a, z = np.flatnonzero(on), np.flatnonzero(off)
            w = np.searchsorted(base, a, "right") - 1
            tags = np.array([r[2] for r in rows], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(doc[w], pa.int64(), mask=doc[w] == _NONE), pa.array(tags[w]), pa.array(start[w] + a - base[w]), pa.array(start[w] + z - base[w] + length)], names=["doc_id", "tag", "a", "z"])

        last = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if size >= SORT_BYTES and row[0] != last:
                    yield settle(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[5])
        if held:
            yield settle(held)

    return runs.sortWithinPartitions("anchor").mapInArrow(run, SPANS)


def suffix_dedup(docs: DataFrame, *, length: int = 100, most_runs: int = MOST_RUNS) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes)."""
    if not GRAM < length < GRAM + (1 << COUNT_BITS) - 1:
        raise ValueError(f"length must be {GRAM + 1} to {GRAM + (1 << COUNT_BITS) - 2}")
    tagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text").bitwiseAND(F.lit((1 << TAG_BITS) - 1)), F.lit(0)).alias("tag"), "text")
    spark = docs.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = find_runs(tagged, length).repartition(shuffled, "route")
    counted = found.withColumn("n", F.sum(F.when(F.col("kind") == 2, 2).otherwise(1)).over(W.partitionBy("route")))
    runs = common.written(counted.where("kind % 4 in (1, 3) or (kind % 4 = 0 and n > 1)").drop("n", "route"), "suffix-runs")
    start = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    tag = F.shiftright("place", 32 + COUNT_BITS)
    n = F.shiftright("place", 32).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    local = runs.where("kind = 3").select("doc_id", tag.alias("tag"), start.alias("a"), (start + F.col("digest")).alias("z"))
    cand = runs.where("kind % 4 < 2").select("anchor", "digest", F.floor(F.col("kind") / 4).alias("at"), "doc_id", tag.alias("tag"), start.alias("start"), n.alias("n"))
    firsts = cand.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    sizes = firsts.groupBy("anchor").agg(F.count("*").alias("contexts"))
    copies, heads = _copies_and_heads(cand, firsts, sizes, ["anchor", "digest"], length)
    wanted = heads.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("anchor", "start", "n", "contexts", "at")).alias("runs"))
    pieces = common.written(_cut_runs(tagged, wanted, length), "suffix-pieces")
    spans, tables, level = [local, copies], [runs, pieces], 0
    while True:
        few = pieces.where(F.col("contexts") <= most_runs).repartition(shuffled, "anchor")
        spans.append(sort_runs(few.select("anchor", "doc_id", "tag", "start", "n", "bytes", "at"), length))
        many = pieces.where(F.col("contexts") > most_runs)
        if not many.limit(1).count():
            break
        level += 1
        parts = common.written(_halves(many, length, level), "suffix-parts")
        firsts = parts.groupBy("anchor", "bytes").agg(F.min(F.struct("doc_id", "start")).alias("first"))
        sizes = firsts.groupBy("anchor").agg(F.count("*").alias("contexts"))
        copies, heads = _copies_and_heads(parts, firsts, sizes, ["anchor", "bytes"], length)
        pieces = common.written(heads.select("anchor", "contexts", "doc_id", "tag", "start", "n", "bytes", "at"), "suffix-pieces")
        spans.append(copies)
        tables += [parts, pieces]
    every = reduce(DataFrame.unionByName, spans)
    merged = common.written(every.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("a", "z")).alias("spans")), "suffix-spans")
    common.drop(*tables)
    return _cut_texts(tagged, merged)


def _copies_and_heads(runs: DataFrame, firsts: DataFrame, sizes: DataFrame, same: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """SPANS of the runs that an equal run precedes, and the first runs whose anchor has others, with their number."""
    placed, here = runs.join(firsts, same), F.struct("doc_id", "start")
    copies = placed.where(here > F.col("first")).select("doc_id", "tag", F.col("start").alias("a"), (F.col("start") + F.col("n") + F.lit(length - 1)).alias("z"))
    return copies, placed.where(here <= F.col("first")).join(sizes.where("contexts > 1"), "anchor")


def _join(tagged: DataFrame, other: DataFrame, how: str) -> DataFrame:
    other = other.withColumnsRenamed({"doc_id": "d", "tag": "g"})
    return tagged.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("g")), how).drop("d", "g")


def _cut_runs(tagged: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs: (anchor, contexts, doc_id, tag, start, n, bytes, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, tag, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(r["anchor"], r["contexts"], doc_id, tag, r["start"], r["n"], raw[r["start"] : r["start"] + r["n"] + length - 1], r["at"]) for r in runs]
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(columns)], names=["anchor", "contexts", "doc_id", "tag", "start", "n", "bytes", "at"])

    joined = _join(tagged, wanted, "inner")
    return joined.select("doc_id", "tag", "text", "runs").mapInArrow(run, "anchor long, contexts long, doc_id long, tag long, start long, n long, bytes binary, at long")


def _halves(pieces: DataFrame, length: int, level: int) -> DataFrame:
    """The runs of pieces cut by the anchor's place in their windows, each part under the longer anchor of its places.

    The places 0..length - 32 fall into 2**level cells. All windows of a cell have the bytes between the start of the
    window with the least place and the end of the one with the greatest in common; their digest with the cell and the
    anchor names the group.
    """
    width = -(-(length - GRAM + 1) >> level)
    last = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            out: list[tuple] = []
            for anchor, doc_id, tag, start, n, raw, at in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                least = at - n + 1
                for cell in range(least // width, at // width + 1):
                    low, high = max(cell * width, least), min(cell * width + width - 1, at)
                    held = raw[at - cell * width : at - min(cell * width + width - 1, last) + length]
                    name = xxh3_64_intdigest(held, (anchor ^ (cell << 8) ^ level) & ((1 << 64) - 1))
                    out.append((name - (1 << 64) if name >> 63 else name, doc_id, tag, start + at - high, high - low + 1, raw[at - high : at - low + length], high))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(columns)], names=["anchor", "doc_id", "tag", "start", "n", "bytes", "at"])

    rows = pieces.select("anchor", "doc_id", "tag", "start", "n", "bytes", "at")
    return rows.mapInArrow(run, "anchor long, doc_id long, tag long, start long, n long, bytes binary, at long")


def _cut_texts(tagged: DataFrame, spans: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, cuts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, at, n = [], 0, 0
                end = -1
                for s in sorted(cuts or (), key=lambda s: s["a"]):
                    if s["a"] > end:
                        n += 1
                        kept.append(raw[at : s["a"]])
                    at = end = max(end, s["z"])
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((doc_id, len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = _join(tagged, spans, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
