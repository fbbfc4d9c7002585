"""The daily batch as Structured Streaming: deduplication, windows, sessions, late data, keyed state.

Each function takes a streaming DataFrame and returns one; run() drives it through what is there now, with its offsets
and state in the shared checkpoint folder, and hands the result back as a table. A lost executor repeats a micro-batch
from its offsets, and the batch number keeps the repeat from counting twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from ..sources.graph import shared_folder


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dedup(stream: DataFrame, keys: Sequence[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def windowed(stream: DataFrame, ts: str, size: str, slide: str | None, keys: Sequence[str], late: str | None = "1 hour") -> DataFrame:
    """Counts per tumbling or sliding window and key. With late=None no row is too late and every window stays in the state."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (stream.withWatermark(ts, late) if late else stream).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, ts: str, gap: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_and_last(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """Per key the first and last time seen and the count, kept as state from batch to batch."""
    schema = f"{key} long, first_seen timestamp, last_seen timestamp, seen long"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        for b in batches:
            lo, hi, n = b[ts].min(), b[ts].max(), n + len(b)
            lo, hi = int(lo.value), int(hi.value)
            first, last = lo if first is None else min(first, lo), hi if last is None else max(last, hi)
        state.update((first, last, n))
        yield pd.DataFrame({key: [k[0]], "first_seen": [pd.Timestamp(first)], "last_seen": [pd.Timestamp(last)], "seen": [n]})

    return stream.select(key, ts).groupBy(key).applyInPandasWithState(update, schema, "first long, last long, n long", "update", "NoTimeout")


def run(stream: DataFrame, keys: Sequence[str] | None, mode: str, tag: str) -> DataFrame:
    """Runs the stream over all that is available. With keys, a later batch's row of a key replaces an earlier one's."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/lodegraph/stream-{tag}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    rows = spark.read.schema(schema).parquet(f"{base}/out")
    if not keys:
        return rows.select(*stream.columns)
    newest = W.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select(*stream.columns)
