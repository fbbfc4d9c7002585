"""Operator 4: near copies by SimHash, joined on blocks of the fingerprint (pigeonhole), verified by Hamming distance.

64-bit fingerprints are cut into four blocks of 16 bits. Two that differ in at most two bits agree on at least two
whole blocks, so each distinct fingerprint is keyed by its six pairs of blocks and compared with those of equal key.
Fingerprints are joined, not documents: copies cost one row. A key that gathers more than `most` distinct
fingerprints is not compared pair by pair: its fingerprints are keyed by every value within one bit of them instead.
Two values lie within two bits exactly if they share such a key, and no key can have more than 65 of them, so this
is exact and its rows are 65 per fingerprint.

Edge cases: null text counts as empty; texts without a word have fingerprint zero and link like any other; fewer
words than a shingle make one shingle; repeated rows each get their row; an empty table gives no rows; further
columns are not read. A null doc_id is carried, and is the least id of a component only if that has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BLOCK_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle of a whole text, in order."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both of bytes: ASCII only, space and 09 to 0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - k + 1
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(first[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a whole text as a signed 64-bit number."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    columns = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp) for each row of docs (doc_id, text); h is the text's hash, which tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp, pa.int64())], names=["doc_id", "h", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


def links(fps: DataFrame, most: int = 32) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in fps (fp) that connect all within two bits of each other."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*[F.struct(F.lit(k).alias("pair"), (block(a) * 65536 + block(b)).alias("key")) for k, (a, b) in enumerate(BLOCK_PAIRS)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.pair", "k.key")
    sizes = keyed.groupBy("pair", "key").count().where("count > 1")
    small = keyed.join(sizes.where(F.col("count") <= most).drop("count"), ["pair", "key"])
    other = small.withColumnRenamed("fp", "b")
    pairs = small.withColumnRenamed("fp", "a").join(other, ["pair", "key"]).where("a < b").where(F.expr("bit_count(a ^ b) <= 2")).select("a", "b").distinct()
    full = keyed.join(sizes.where(F.col("count") > most).drop("count"), ["pair", "key"]).select("fp").distinct()
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    balls = full.select("fp", F.explode(near).alias("near"))
    heads = balls.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.unionByName(balls.join(heads, "near").where("a < fp").select("a", F.col("fp").alias("b"))).distinct()


def _grouped(docs: DataFrame, shingle: int, most: int) -> DataFrame:
    """(doc_id, h, fp, component_id) per row of docs."""
    prints = common.written(fingerprints(docs, shingle), "simhash")
    classes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    # Least ids name the classes: one document has one fingerprint. Rows that repeat an id may name two classes
    # alike, so classes are linked by fingerprint and the least id is taken per component.
    found = common.written(links(classes.select("fp"), most), "simhash-links")
    parts = common.components(found, "simhash-components").withColumnsRenamed({"node": "fp"})
    named = classes.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = common.written(named.join(least, "component").select("fp", "component_id"), "simhash-ids")
    return prints.join(of, "fp")


def simhash_components(docs: DataFrame, *, shingle: int = 3, most: int = 32) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links)."""
    return _grouped(docs, shingle, most).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, *, shingle: int = 3, most: int = 32) -> DataFrame:
    """docs with the rows of one document of each component: its least doc_id.

    Rows that share that id but not the text are different documents, and those whose component has the id stay. Of
    rows that repeat id and text one stays, the least by its other columns as JSON. Rows of null doc_id cannot be told
    apart by id and stay.
    """
    own, text_hash, nth, kept_id, kept_hash = (common.fresh(docs, c) for c in ("_own", "_hash", "_nth", "_kept_id", "_kept_hash"))
    kept = _grouped(docs, shingle, most).where("doc_id = component_id").select(F.col("doc_id").alias(kept_id), F.col("h").alias(kept_hash)).distinct()
    kept = common.written(kept, "simhash-kept")
    rows = docs.where("doc_id is not null").withColumn(own, F.col("doc_id").cast("long")).withColumn(text_hash, F.xxhash64("text"))
    rows = rows.join(kept, (F.col(own) == F.col(kept_id)) & (F.col(text_hash) == F.col(kept_hash)))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = W.partitionBy(own, text_hash).orderBy(F.to_json(F.struct(*others)) if others else F.lit(""))
    out = rows.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*docs.columns)
    return out.unionByName(docs.where("doc_id is null"))
