"""Operator 5: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: the budget is shared by weight; a source's share stops at `most` times its size and what is left over is
   shared again by weight (the level of a water-fill, found from running sums over the sources).
2. Quotas: the budget in blocks of `block` words is dealt to the sources by the highest quotients target / (2k - 1),
   and each source's blocks to its shards by the highest quotients size / (2k - 1): whole numbers that add up.
3. Selection: a shard lays its documents end to end in seeded order, `most` times over, and cuts this into blocks. Of
   n blocks the q taken are those b with floor(((b + 1) q + u) / n) > floor((b q + u) / n), u seeded in 0..n-1: q blocks
   exactly, spread evenly. Both the count and the words of any stretch follow in closed form, so a document's share
   costs one row, whatever the block size.

Shards hold about `shard_words` words (and at most about `shard_docs` documents) of one source, and up to `spread`
shards of a source are made as soon as each has 1024 documents, so that a source with a third of all rows is many
shards. Only counts by source and shard meet in one task.

Edge cases: null text has size 0 and nothing is taken; the null source is a source, the last; a source of size 0 has
target 0; repeated rows are documents of their own; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common


def apportion(df: DataFrame, groups: Sequence[str], key: str, weight: str, seats: str) -> DataFrame:
    """df with column quota: seats (equal in a group) dealt by the highest quotients weight / (2k - 1).

    With n rows, Q seats and exact shares s = Q * weight / total, the k-th seats that are in doubt lie within
    s * n / (2Q) + 1/2 of s: about 3n rows of quotients in all settle a group, however many seats there are.
    """
    g = W.partitionBy(*groups)
    share = F.when(F.col("_total") > 0, F.col(seats) * F.col(weight) / F.col("_total")).otherwise(F.lit(0.0))
    slack = F.when(F.col(seats) > 0, F.col("_share") * F.col("_n") / (2 * F.col(seats))).otherwise(F.lit(0.0)) + 1.5
    base = df.withColumn("_total", F.sum(weight).over(g).cast("double")).withColumn("_n", F.count("*").over(g)).withColumn("_share", share)
    base = base.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_share") - slack)).cast("long")).withColumn("_high", F.ceil(F.col("_share") + slack).cast("long"))
    base = base.withColumn("_left", F.col(seats) - F.sum("_low").over(g))
    in_doubt = base.where(F.col(weight) > 0).withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    rank = F.row_number().over(g.orderBy((F.col(weight) / (2 * F.col("_k") - 1)).desc(), F.col(key).asc_nulls_last(), "_k"))
    won = in_doubt.withColumn("_r", rank).where("_r <= _left").groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], F.col(key).alias("_key")).agg(F.count("*").alias("_won"))
    on = F.col(key).eqNullSafe(F.col("_key"))
    for i, c in enumerate(groups):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = base.join(won, on, "left").withColumn("quota", F.when(F.col(weight) > 0, F.col("_low") + F.coalesce("_won", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return out.select(*df.columns, "quota")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target, ...) from sizes (source, source_size, ...): one row per source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    s = s.withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(everything)).withColumn("_top", F.lit(float(most)) * F.col("source_size"))
    by_level = W.orderBy(F.col("_top") / F.col("_w"), F.col("source").asc_nulls_last())
    s = s.withColumn("_below", F.coalesce(F.sum("_top").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_rest", F.sum("_w").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_budget") - F.col("_below")) / F.col("_rest"))
    s = s.withColumn("_full", F.col("_top") <= F.col("_level") * F.col("_w"))
    # The level of the first source that is not full holds for all that are not.
    s = s.withColumn("_level", F.min(F.when(~F.col("_full"), F.struct((F.col("_top") / F.col("_w")).alias("at"), F.col("_level").alias("level")))).over(everything)["level"])
    return s.withColumn("target", F.when(F.col("_full"), F.col("_top")).otherwise(F.col("_level") * F.col("_w"))).select(*sizes.columns, "target")


def _before(at: Column, n: Column, q: Column, u: Column, block: int) -> Column:
    """Words taken of the first `at` words of a shard's layout."""
    b = F.floor(at / block)
    upto = lambda x: F.floor((x * q + u) / n)  # noqa: E731  exact in doubles: below 2**53
    return (upto(b) - F.floor(u / n)) * block + (at - b * block) * (upto(b + 1) - upto(b))


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 32, shard_words: int = 1 << 22, shard_docs: int = 1 << 16, spread: int = 1024, seed: int = 11) -> DataFrame:
    """Per row of docs: doc_id, size, source, source_size, target, taken, and its place in the layout.

    first, words, blocks, quota and offset say where the document lies in its shard's layout of `words` words and
    which blocks are taken; taken_ranges() turns them into word ranges.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    sized = common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, most)
    seats = F.round(F.sum("target").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) / block).cast("long")
    sources = apportion(sources.withColumn("_all", F.lit(0)).withColumn("seats", seats), ["_all"], "source", "target", "seats")
    parts = F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_docs") / shard_docs), F.least(F.ceil(F.col("n_docs") / 1024), F.lit(spread)), F.lit(1))
    sources = common.written(sources.select("source", "source_size", "target", F.col("quota").alias("source_quota"), parts.alias("parts")), "mix-sources")

    left = sized.withColumnRenamed("source", "s")
    placed = left.join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.col("parts")))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("seats"))
    quotas = apportion(shards, ["source"], "shard", "words", "seats").withColumn("blocks", F.ceil(most * F.col("words") / block))
    quotas = quotas.select(F.col("source").alias("s"), F.col("shard").alias("p"), "words", "blocks", F.least("quota", "blocks").alias("quota"))
    quotas = quotas.withColumn("offset", F.pmod(F.xxhash64(F.lit(seed + 1), "s", "p"), F.greatest("blocks", F.lit(1))))
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "text_hash"), "doc_id")
    laid = placed.withColumn("first", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    laid = laid.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("p"))).drop("s", "p")
    taken = F.lit(0)
    for turn in range(most):
        at = F.col("first") + turn * F.col("words")
        taken = taken + _before(at + F.col("size"), F.col("blocks"), F.col("quota"), F.col("offset"), block) - _before(at, F.col("blocks"), F.col("quota"), F.col("offset"), block)
    taken = F.when((F.col("size") > 0) & (F.col("blocks") > 0), taken).otherwise(F.lit(0)).cast("long")
    return laid.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.alias("taken"), "shard", "first", "words", "blocks", "quota", "offset")


def taken_ranges(first: int, size: int, blocks: int, quota: int, offset: int, block: int) -> list[tuple[int, int]]:
    """The word ranges of a document, at `first` of a layout, that lie in taken blocks; neighbours are joined."""
    out: list[tuple[int, int]] = []
    for b in range(first // block, (first + size - 1) // block + 1) if size else ():
        if ((b + 1) * quota + offset) // blocks > (b * quota + offset) // blocks:
            lo, hi = max(b * block - first, 0), min((b + 1) * block - first, size)
            if out and out[-1][1] == lo:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
    return out


def mixed_documents(docs: DataFrame, *, most: int = 2, block: int = 32, **options) -> DataFrame:
    """The mix itself, with the columns of docs: per document and turn one row with the words that this turn takes.

    A turn that takes all words has the text as it is; otherwise the taken stretches of the text, joined by spaces.
    A document of which nothing is taken has no row. n_chars, where there is one, follows the text.
    """
    import re

    places = ("first", "words", "blocks", "quota", "offset")
    own_id, own_hash, text_hash, *place_names = (common.fresh(docs, f"_{c}") for c in ("id", "hash", "text_hash", *places))
    plan = mix(docs, most=most, block=block, **options).where("taken > 0").dropDuplicates(["doc_id", "text_hash"])
    plan = plan.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), *[F.col(c).alias(n) for c, n in zip(places, place_names, strict=True)])
    names, schema = docs.columns, docs.schema
    own = docs.withColumn(text_hash, F.xxhash64("text"))
    own = own.join(plan, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(text_hash) == F.col(own_hash)))
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(common.WORD)
        for batch in batches:
            rows, texts = [], []
            place = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in place_names]
            for i, (text, first, words, blocks, quota, offset) in enumerate(zip(batch.column(at).to_pylist(), *place, strict=True)):
                spans = None
                for turn in range(most):
                    spans = spans or [m.span() for m in word.finditer(text)]
                    ranges = taken_ranges(first + turn * words, len(spans), blocks, quota, offset, block)
                    if ranges:
                        rows.append(i)
                        texts.append(text if ranges == [(0, len(spans))] else " ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in ranges))
            out = batch.take(pa.array(rows, pa.int64())).select(names)
            columns = list(out.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([len(t) for t in texts], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return own.mapInArrow(cut, schema)
