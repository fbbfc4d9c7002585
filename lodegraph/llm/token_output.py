"""Operator 1: token ids as bit-packed blocks in ascending doc_id order.

File format: a Parquet table of blocks, so that Spark's committers guard it and any store holds it. One row:

    shard, block    place; shards ascend by doc_id, blocks by place in the shard
    start           ids of the shard before this block
    n_tokens, bits  ids in payload, each in `bits` bits (the fewest that hold the vocabulary), least bit first
    doc_ids, lens   the documents of this block in order, and their ids' counts with the end id
    payload         the packed ids

A block holds whole documents and ends with the one that fills it, so every block is unpacked alone, and id k of
a block starts at bit k * bits (random access).

Edge cases: null or empty text gives the end id alone; a null doc_id sorts first; rows that repeat a doc_id each
get their own entry, in the order of their texts' hashes; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common
from .tokenize import encoder, load_spec

BLOCKS = "shard int, block int, start long, n_tokens long, bits int, doc_ids array<long>, lens array<long>, payload binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), 1 << 16):  # a multiple of 8 ids fills whole bytes
        part = ids[i : i + (1 << 16)].astype(np.uint32)
        out.append(np.packbits(((part[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, first: int, last: int) -> np.ndarray:
    """ids first..last-1 of a block, touching only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}")[first:last].astype("<u4")
    raw = np.frombuffer(payload, dtype=np.uint8)[first * bits // 8 : (last * bits + 7) // 8]
    skip = first * bits % 8
    flat = np.unpackbits(raw, bitorder="little")[skip : skip + (last - first) * bits].reshape(-1, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_blocks(docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int, shards: int | None = None, block_tokens: int = 1 << 16) -> DataFrame:
    """Writes the blocks of docs (doc_id, text) to path and returns them as read back."""
    spark = docs.sparkSession
    spec = load_spec(tokenizer_path)
    bits = bits_for(max(encoder(spec).tokenizer.get_vocab_size(), end_id + 1))
    sent = spark.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(sent.value)
        end = np.array([end_id], dtype="<u4").tobytes()
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        block = start = held = 0
        ids: list[bytes] = []
        lens: list[int] = []
        doc_ids: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            all_ids = np.frombuffer(b"".join(ids), dtype="<u4")
            row = [shard, block, start, len(all_ids), bits, list(doc_ids), list(lens), pack(all_ids, bits)]
            block, start, held = block + 1, start + len(all_ids), 0
            for x in (ids, lens, doc_ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = enc.ids(text.as_py())
                ids += [own.tobytes(), end]
                lens.append(len(own) + 1)
                doc_ids.append(doc_id)
                held += len(own) + 1
                if held >= block_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "zstd").parquet(path)
    return read_blocks(spark, path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def document_index(blocks: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and its place (shard, block, first)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["lens"], dtype=np.int64)
                at = np.concatenate([[0], np.cumsum(lens)])
                ids = unpack(row["payload"], row["bits"], 0, row["n_tokens"])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                n = len(lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(n, row["shard"]), pa.int32()), pa.array(np.full(n, row["block"]), pa.int32()), pa.array(at[:-1]), pa.array(row["start"] + at[:-1]), pa.array(lens), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "block", "first", "in_shard", "n_tokens", "ids_crc32"],
                )

    docs = blocks.mapInArrow(index, "doc_id long, shard int, block int, first long, in_shard long, n_tokens long, ids_crc32 long")
    # One row per shard, and their number is a parameter: a window over all of them, and a broadcast, stay small.
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard", "block", "first")


def token_output(docs: DataFrame, *, tokenizer_path: str, end_id: int, path: str | None = None, **options) -> DataFrame:
    """Writes docs as token files and returns the index read back from them."""
    path = path or common.new_path(docs.sparkSession, "tokens")
    return document_index(write_blocks(docs, path, tokenizer_path=tokenizer_path, end_id=end_id, **options))
