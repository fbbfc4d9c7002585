"""Operator 4 at a given similarity: SimHash proposes the closest pairs, MinHash bands the others, the texts decide.

Two texts of Jaccard similarity 0.8 differ in six to seven bits of 64 in the middle, and pigeonhole blocks for so many
bits are too short to be keys. So the fingerprints of operator 4 propose what lies within two bits, by its own blocks;
what they can't reach is proposed by bands: each distinct text has 100 minima of its hashed shingles in 20 bands of 5,
and texts that share a band are candidates. A pair of similarity s is one with probability 1 - (1 - s^5)^20: 0.9996 at
0.8. Every link is verified on both whole texts, so no pair below the threshold is linked.

Pairs are never rows. The texts of a band come together in groups of a few hundred, and a task compares those of its
group that no link has joined yet, by an inverted index of their shingles. A band of more texts is cut into groups by a
hash; then those outside its largest component meet all others, group by group, so that no pair that could join two
components is left out. Steps (fingerprints and some bands, all bands, groups of large bands) take only bands that still
hold two components: what one step has joined, the next doesn't compare.

Edge cases: words are runs of bytes other than ASCII white space, ASCII capitals as small letters; fewer words than a
shingle make one shingle; texts without a word are equal to each other; null counts as empty; an empty table gives no
rows. Of rows that repeat doc_id and text one stays, the least by its other columns as JSON; rows that share a doc_id
but not the text are different documents. Rows of null doc_id stay, and are never the document that stays for others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common
from .simhash import fingerprint_of, links, shingle_hashes

BANDS, ROWS = 20, 5
#: The bands of the first step, which join most pairs of similarity 0.9 or more.
FIRST_BANDS = 4
#: A group of texts that one task compares: about so many texts, and about so many shingles.
GROUP_TEXTS, GROUP_SHINGLES = 256, 1_000_000
_DRAW = np.random.default_rng(20240101)
_FACTORS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(h: np.ndarray) -> list[int]:
    """One signed 64-bit key per band, of a set of shingles; a text without a word has the one key 0."""
    from xxhash import xxh64_intdigest

    if not len(h):
        return [0]
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 2048):
        least = np.minimum(least, (h[i : i + 2048, None] * _FACTORS + _SHIFTS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def group_links(sets: list[np.ndarray], components: list, chunks: list[int], percent: int) -> list[tuple]:
    """Pairs of components that similar sets of a group join, as a forest.

    Sets of one chunk have met before if the group has two chunks, and only those of different chunks are compared.
    """
    size = np.array([len(s) for s in sets], np.int64)
    names: dict = {}
    root = np.array([names.setdefault(c, len(names)) for c in components], np.int64)
    of = list(names)
    part = np.array(chunks, np.int64)
    across = len(set(chunks)) > 1
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[order]
    ends = np.cumsum(np.bincount(token, minlength=1))
    begins = ends - np.bincount(token, minlength=1)
    at = np.concatenate([[0], np.cumsum(size)])
    asking = np.flatnonzero(part == min(chunks)) if across else np.arange(len(sets) - 1)
    out = []
    for x in asking:
        open_ = (root != root[x]) & ((part != part[x]) if across else (np.arange(len(sets)) > x))
        if not open_.any():
            continue
        first, n = begins[token[at[x] : at[x + 1]]], (ends - begins)[token[at[x] : at[x + 1]]]
        place = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        both = np.bincount(holder[place], minlength=len(sets))
        for y in np.flatnonzero(open_ & (100 * both >= percent * (size[x] + size - both))):
            if root[y] != root[x]:
                out.append((of[root[x]], of[root[y]]))
                root[root == root[y]] = root[x]
    return out


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))


def _proposals(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, fp, size, keys) per row of docs: fingerprint, shingles and band keys of its text, from one pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), shingle) for t in batch.column(1)]
            columns = [pa.array([fingerprint_of(h) for h in hashes], pa.int64()), pa.array([len(h) for h in hashes], pa.int64())]
            keys = pa.array([band_keys(np.unique(h)) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, keys], names=["node", "fp", "size", "keys"])

    return _texts(docs).select("node", "text").mapInArrow(run, "node binary, fp long, size long, keys array<long>")


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """(key, node) with two nodes to a key: pairs that join all in prints (node, fp, size) that lie within two bits."""
    heads = prints.groupBy("fp").agg(F.min("node").alias("head"))
    same = prints.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    one, two = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    near = links(heads.select("fp")).join(one, "a").join(two, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    pairs = same.unionByName(near).select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("node"))
    return pairs.join(prints.select("node", "size"), "node").select("key", "node", "size")


def _compared(rows: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between components, found in the groups (key, i, j) of rows (key, i, j, chunk, node, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            found = group_links(sets, components, chunks, percent) if len(set(components)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

        now, sets, components, chunks = None, [], [], []
        for batch in batches:
            for key, i, j, chunk, c, text in zip(*(batch.column(k) for k in range(6)), strict=True):
                group = (key.as_py(), i.as_py(), j.as_py())
                if group != now:
                    if sets:
                        yield done()
                    now, sets, components, chunks = group, [], [], []
                sets.append(shingles(text.as_py(), shingle))
                components.append(c.as_py())
                chunks.append(chunk.as_py())
        if sets:
            yield done()

    full = rows.join(texts, "node").select("key", "i", "j", "chunk", "c", "text")
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a binary, b binary").distinct()


def _groups(texts: str, size: str):
    return F.ceil(F.greatest(F.col(texts) / F.lit(GROUP_TEXTS), F.col(size) / F.lit(GROUP_SHINGLES), F.lit(1.0))).cast("long")


def _open(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows (key, node, size) of keys with two components or more, with c, the key's largest component and groups."""
    of = rows.join(parts, "node")
    per = of.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    top = F.max(F.struct("n", "c", "s"))
    keys = per.groupBy("key").agg(top.alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k")).where("k > 1")
    keys = keys.select("key", F.col("top.c").alias("top"), F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"), "top.n", "top.s", _groups("n", "s"))
    return of.join(keys.toDF("key", "top", "n_out", "s_out", "n_top", "s_top", "groups"), "key")


def _within(rows: DataFrame) -> DataFrame:
    """Groups of each key by a hash of the node, each for itself."""
    chunk = F.pmod(F.xxhash64("node"), "groups")
    return rows.select("key", chunk.alias("i"), chunk.alias("j"), chunk.alias("chunk"), "node", "c")


def _across(rows: DataFrame) -> DataFrame:
    """For keys of several groups: the nodes outside the largest component meet each other and all of that component."""
    rows = rows.where("groups > 1").withColumn("outs", _groups("n_out", "s_out")).withColumn("tops", _groups("n_top", "s_top"))
    outside = F.col("c") != F.col("top")
    chunk = F.when(outside, F.pmod(F.xxhash64("node"), "outs")).otherwise(F.col("outs") + F.pmod(F.xxhash64("node"), "tops"))
    others = F.sequence(F.lit(0).cast("long"), F.when(outside, F.col("outs") + F.col("tops") - 1).otherwise(F.col("outs") - 1))
    rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(others))
    return rows.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "c")


def one_per_group(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of similar texts: that of least doc_id, and of those the least text digest."""
    nodes = common.written(_texts(docs).groupBy("node").agg(F.min("doc_id").alias("least")), "near-nodes")
    proposed = common.written(_proposals(docs, shingle), "near-proposals")
    keyed = proposed.select("node", "size", F.posexplode("keys").alias("band", "key")).distinct()
    bands = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = common.written(keyed.join(bands, "key"), "near-shared").select("key", "node", "size", "band")
    close = common.written(_by_fingerprint(proposed.select("node", "fp", "size").distinct()), "near-close")
    wanted = shared.select("node").union(close.select("node")).distinct()
    # By the least id as well, so that copies of one text don't meet in one task.
    wanted = nodes.join(wanted, "node").select("node", F.col("least").alias("doc_id"))
    of = _texts(docs).alias("t").join(wanted.alias("w"), F.expr("t.node = w.node AND t.doc_id <=> w.doc_id"), "left_semi")
    texts = common.written(of.groupBy("node").agg(F.first("text").alias("text")), "near-texts")

    parts = nodes.select("node", F.col("node").alias("c"))
    first = close.unionByName(shared.where(F.col("band") < FIRST_BANDS).drop("band"))
    for rows, dealt in ((first, _within), (shared, _within), (shared, _across)):
        found = common.written(_compared(dealt(_open(rows, parts)), texts, shingle, percent), "near-links")
        merged = common.components(found, "near-components").toDF("c", "new")
        parts = common.written(parts.join(merged, "c", "left").select("node", F.coalesce("new", "c").alias("c")), "near-parts")

    kept = nodes.join(parts, "node").where("least is not null").groupBy("c").agg(F.min(F.struct("least", "node")).alias("x")).select("x.least", "x.node")
    own, node, nth, kept_id, kept_node = (common.fresh(docs, c) for c in ("_own", "_node", "_nth", "_kept_id", "_kept_node"))
    kept = common.written(kept.toDF(kept_id, kept_node), "near-kept")
    rows = docs.where("doc_id is not null").withColumn(own, F.col("doc_id").cast("long")).withColumn(node, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    rows = rows.join(kept, (F.col(own) == F.col(kept_id)) & (F.col(node) == F.col(kept_node)))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    nth_of = W.partitionBy(own, node).orderBy(F.to_json(F.struct(*others)) if others else F.lit(""))
    out = rows.withColumn(nth, F.row_number().over(nth_of)).where(F.col(nth) == 1).select(*docs.columns)
    return out.unionByName(docs.where("doc_id is null"))
