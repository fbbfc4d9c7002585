"""Operator 12: hard negatives by a distributed nearest-neighbour join over a Voronoi partition.

Inner products become distances: every row x gets one more component sqrt(M^2 - |x|^2), M the greatest norm, and every
anchor is stretched to the norm M, which changes no order, and gets a zero. So |a' - x'|^2 = 2 M^2 - 2 a'.x, and
greater products are lesser distances. A bounded sample of rows gives the pivots. Each row lies in the cell of its nearest pivot, and a cell is known by its radius; anchors are
grouped by the nearest of the first pivots, and crowded groups are split.

The same sample gives each anchor a bound: the k-th best product it finds there. With the anchors' distances to their
pivot this gives, per group, the distances from the pivot at which a row can still matter to any anchor of the group.
By the triangle inequality a row beyond them serves no anchor there. So cells whose radius lies beyond are not looked
at, and of the others only the rows within the bounds are sent, as packed blocks, to the group's tasks. There a block
is multiplied with the group's anchors, and the best of each anchor are kept. Anchors of a group go to several tasks,
each with a share of the rows. What the tasks find is ranked in the end, k rows per anchor and task.

The join runs twice: for the positives (same label, no limits), then for the negatives (another label, products within
the limits that each positive sets). All products are of integers, in float64 below 2^53, hence exact; bounds have a
margin for rounding, and decide only what need not be sent. Where vectors have no structure, as in many dimensions at
random, bounds exclude little, and every row goes to every group once; that is the work of comparing the stated
anchors with all rows.

Edge cases: rows with a null id, label or vector, or a component that is null, NaN or infinite take no part; shorter
vectors count as filled up with zeros; rows that repeat an id are rows of their own, but not "other" rows to each other;
equal products go by the lesser id; anchors without positives or negatives have no rows; empty tables give no rows;
further columns are not read. Vectors of a squared norm (in steps) of 2^50 or more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

#: Rows of the sample that gives pivots and first bounds, and the greatest number of cells.
SAMPLE, MOST_CELLS = 4096, 1024
#: Anchors in a group at most, about; rows per task that a group's rows are dealt to; rows in a packed block.
GROUP_ANCHORS, TASK_ROWS, LEAST_TASKS, BLOCK_ROWS = 8192, 1 << 20, 4, 8192
#: Anchors multiplied with a block at a time, found pairs held before they are cut to the best, groups held by a task.
SLICE, HELD_PAIRS, HELD_GROUPS = 256, 1 << 20, 4
#: Twice this is the margin of the bounds, as a share of the distances in question.
MARGIN = 1e-7
ROWS = "vec_id long, label long, vec binary, norm2 double"
BLOCKS = "pivot int, part int, task int, ids binary, labels binary, vecs binary"
FOUND = "anchor long, nth int, other long, score long"


def quantised(vectors: DataFrame, step: float) -> DataFrame:
    """ROWS of vectors (vec_id, label, embedding): components times step, rounded down, as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, label, v in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                v = v.values
                if v.null_count:
                    continue
                x = np.floor(step * v.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    norm2 = float(x @ x)
                    out.append((i, label, x.astype("<i4").tobytes() if norm2 < 2.0**50 else b"", norm2))
            yield _batch(out, ROWS)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").mapInArrow(run, ROWS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _matrix(vecs: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(vecs), dim))
    for row, v in zip(out, vecs, strict=True):
        x = np.frombuffer(v, "<i4")
        row[: len(x)] = x
    return out


class Cells:
    """Pivots in the augmented space and the sample behind them; at most SAMPLE rows, sent to every task."""

    def __init__(self, sample: list[tuple], dim: int, most2: float, n_cells: int, n_groups: int) -> None:
        self.dim, self.most2, self.n_groups = dim, most2, n_groups
        self.ids, self.labels = (np.array([r[k] for r in sample], np.int64) for k in (0, 1))
        self.vectors = _matrix([r[2] for r in sample], dim)
        self.pivots = self.augmented(self.vectors[:n_cells])
        self.radius: np.ndarray | None = None

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.most2 - (x * x).sum(1), 0))])

    def distances(self, augmented: np.ndarray, n: int) -> np.ndarray:
        p = self.pivots[:n]
        return np.sqrt(np.maximum((augmented**2).sum(1)[:, None] + (p * p).sum(1) - 2 * augmented @ p.T, 0))


def best(anchor: np.ndarray, nth: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best per (anchor, nth): by score, ties by the lesser id."""
    order = np.lexsort((ids, -scores, nth, anchor))
    a, n = anchor[order], nth[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (n[1:] != n[:-1])])) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return order[rank < k]


class Search:
    """The anchors of a group and the best rows they have met: `least` rises as better ones are found."""

    def __init__(self, ids, labels, vectors, low, high, k: int, same: bool) -> None:
        self.ids, self.labels, self.vectors, self.low, self.high, self.k, self.same = ids, labels, vectors, low, high, k, same
        self.found: list[tuple] = []
        self.pairs = 0

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        turned = vectors.T
        for at in range(0, len(self.ids), SLICE):
            part = slice(at, at + SLICE)
            score = self.vectors[part] @ turned
            of = self.labels[part, None] == labels
            of = of & (self.ids[part, None] != ids) if self.same else ~of
            for n in range(self.low.shape[1]):
                a, x = np.nonzero(of & (score >= self.low[part, n, None]) & (score <= self.high[part, n, None]))
                if len(a):
                    self.found.append((a + at, np.full(len(a), n), ids[x], score[a, x].astype(np.int64)))
                    self.pairs += len(a)
            if self.pairs > HELD_PAIRS:
                self.cut()

    def cut(self) -> tuple:
        """The best found so far, as columns; what falls behind a full list's last goes."""
        a, n, i, s = (np.concatenate([f[c] for f in self.found]) if self.found else np.zeros(0, np.int64) for c in range(4))
        keep = best(a, n, i, s, self.k)
        a, n, i, s = a[keep], n[keep], i[keep], s[keep]
        self.found, self.pairs = [(a, n, i, s)], 0
        if len(a):
            end = np.flatnonzero(np.concatenate([(a[1:] != a[:-1]) | (n[1:] != n[:-1]), [True]]))
            full = np.diff(np.concatenate([[-1], end])) == self.k
            at = end[full]
            self.low[a[at], n[at]] = np.maximum(self.low[a[at], n[at]], s[at])
        return a, n, i, s


def bounded_anchors(anchors: DataFrame, sent, k: int, same: bool) -> DataFrame:
    """anchors (anchor, vec_id, label, vec, limits) with their pivot, their distance to it, raised limits, and the distances within which rows matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, ids, labels, vecs, limits = (batch.column(c).to_pylist() for c in range(5))
            x = _matrix(vecs, cells.dim)
            norm2 = (x * x).sum(1)
            scale = np.sqrt(np.divide(cells.most2, norm2, out=np.ones(len(x)), where=norm2 > 0))
            near = cells.distances(np.column_stack([x * scale[:, None], np.zeros(len(x))]), cells.n_groups)
            pivot = near.argmin(1)
            width = max(map(len, limits))
            low, high = np.full((len(x), width), np.inf), np.full((len(x), width), -np.inf)
            for i, pairs in enumerate(limits):
                for n, p in enumerate(pairs):
                    low[i, n], high[i, n] = p["low"], p["high"]
            search = Search(np.array(ids), np.array(labels), x, low, high, k, same)
            for at in range(0, len(cells.ids), BLOCK_ROWS):
                part = slice(at, at + BLOCK_ROWS)
                search.meet(cells.ids[part], cells.labels[part], cells.vectors[part])
            search.cut()
            low = search.low
            # |a' - x'|^2 = |a'|^2 + M^2 - 2 a'.x: the least and greatest product that matters, as distances
            base = norm2 * scale**2 + cells.most2
            least = np.maximum(np.where(low <= high, low, np.inf).min(1, initial=np.inf), -cells.most2)
            most = np.minimum(np.where(low <= high, high, -np.inf).max(1, initial=-np.inf), cells.most2)
            some = least <= most
            far, close = (np.sqrt(np.maximum(base - 2 * scale * np.where(some, v, 0), 0)) for v in (least, most))
            own = near[np.arange(len(x)), pivot]
            slack = MARGIN * (np.sqrt(base) + own + 1) * 2
            pairs = [[{"low": float(a), "high": float(z)} for a, z in zip(lo, hi, strict=True) if a != np.inf or z != -np.inf] for lo, hi in zip(low, high, strict=True)]
            limit = pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64())]))
            columns = [pa.array(anchor, pa.int64()), pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(vecs, pa.binary()), pa.array(pairs, limit), pa.array(pivot, pa.int32()), pa.array(close - own - slack), pa.array(far + own + slack), pa.array(some)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "vec_id", "label", "vec", "limits", "pivot", "near", "far", "some"])

    limits = "limits array<struct<low:double,high:double>>"
    return anchors.select("anchor", "vec_id", "label", "vec", "limits").mapInArrow(run, f"anchor long, vec_id long, label long, vec binary, {limits}, pivot int, near double, far double, some boolean")


def replicated(rows: DataFrame, sent, groups: dict[int, tuple[int, float, float]], tasks: int) -> DataFrame:
    """BLOCKS: the rows that each group of anchors (pivot, part) might need, dealt to its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = sent.value
        pivots = np.array(sorted(groups), np.int64)
        parts, near, far = (np.array([groups[p][c] for p in pivots]) for c in range(3))
        between = cells.distances(cells.pivots[pivots], len(cells.pivots)) if len(pivots) else np.zeros((0, 0))
        slack = MARGIN * 2 * (np.sqrt(cells.most2) + 1)
        # a cell may serve a group if some distance from the group's pivot within its radius lies within the group's bounds
        serves = (between - cells.radius - slack <= far[:, None]) & (between + cells.radius + slack >= near[:, None])
        turn = 0
        for batch in batches:
            ids, labels, vecs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for start in range(0, len(ids), BLOCK_ROWS):
                part = slice(start, start + BLOCK_ROWS)
                x = _matrix(vecs[part], cells.dim)
                d = cells.distances(cells.augmented(x), len(cells.pivots))
                cell = d.argmin(1)
                out = []
                for g, p in enumerate(pivots):
                    held = np.flatnonzero(serves[g, cell] & (d[:, p] <= far[g]) & (d[:, p] >= near[g]))
                    if len(held):
                        i, lab, v = ids[part][held].tobytes(), labels[part][held].tobytes(), x[held].astype("<i4").tobytes()
                        out += [(int(p), q, turn % tasks, i, lab, v) for q in range(int(parts[g]))]
                turn += 1
                yield _batch(out, BLOCKS)

    return rows.select("vec_id", "label", "vec").mapInArrow(run, BLOCKS)


def searched(joined: DataFrame, dim: int, k: int, same: bool) -> DataFrame:
    """FOUND of blocks joined with their group's anchors: the k best per anchor and limits that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, Search]] = {}

        def flush(key: tuple) -> pa.RecordBatch:
            rows, search = held.pop(key)
            a, n, i, s = search.cut()
            return pa.RecordBatch.from_arrays([pa.array(rows[a], pa.int64()), pa.array(n, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["anchor", "nth", "other", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                pivot, part, task = (batch.column(c)[r].as_py() for c in range(3))
                ids, labels, vecs = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in ((3, "<i8"), (4, "<i8"), (5, "<i4")))
                key = (pivot, part, task)
                if key not in held:
                    if len(held) >= HELD_GROUPS:
                        yield flush(next(iter(held)))
                    group = batch.column(6)[r].values
                    field = lambda f: group.field(f).to_pylist()  # noqa: B023, E731
                    limits = field("limits")
                    low, high = np.full((len(limits), max(map(len, limits))), np.inf), np.full((len(limits), max(map(len, limits))), -np.inf)
                    for at, pairs in enumerate(limits):
                        for n, p in enumerate(pairs):
                            low[at, n], high[at, n] = p["low"], p["high"]
                    held[key] = np.array(field("anchor"), np.int64), Search(np.array(field("vec_id")), np.array(field("label")), _matrix(field("vec"), dim), low, high, k, same)
                held[key][1].meet(ids, labels, vecs.reshape(-1, dim).astype(np.float64))
        for key in list(held):
            yield flush(key)

    return joined.mapInArrow(run, FOUND)


def nearest(rows: DataFrame, anchors: DataFrame, sent, total: int, k: int, same: bool) -> DataFrame:
    """(anchor, nth, other, score, rank): of rows, per anchor and its nth limits, the first k of the same or of another label."""
    bounded = common.written(bounded_anchors(anchors, sent, k, same).where("some"), "negatives-anchors")
    # one row per pivot at most: bounded by MOST_CELLS
    groups = {r["pivot"]: (-(-r["n"] // GROUP_ANCHORS), r["near"], r["far"]) for r in bounded.groupBy("pivot").agg(F.count("*").alias("n"), F.min("near").alias("near"), F.max("far").alias("far")).collect()}
    tasks = max(-(-total // TASK_ROWS), LEAST_TASKS)
    parts = F.element_at(F.create_map(*[F.lit(x) for p, g in groups.items() for x in (p, g[0])]), F.col("pivot")) if groups else F.lit(1)
    grouped = bounded.withColumn("part", F.pmod(F.xxhash64("anchor"), parts).cast("int")).groupBy("pivot", "part")
    grouped = grouped.agg(F.collect_list(F.struct("anchor", "vec_id", "label", "vec", "limits")).alias("anchors")).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    met = replicated(rows, sent, groups, tasks).join(grouped, ["pivot", "part", "task"])
    found = searched(met.select("pivot", "part", "task", "ids", "labels", "vecs", "anchors"), sent.value.dim, k, same)
    rank = F.row_number().over(W.partitionBy("anchor", "nth").orderBy(F.col("score").desc(), "other"))
    return common.written(found.withColumn("rank", rank).where(F.col("rank") <= k), "negatives-found")


def hard_negatives(vectors: DataFrame, *, every: int = 100, step: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Per anchor (vec_id divisible by `every`) and each of its first positives: rank, negative_id and both products.

    Positives are the first other rows of the anchor's label; negatives the first rows of another label whose product is
    from low to high percent of the positive's.
    """
    spark = vectors.sparkSession
    rows = common.written(quantised(vectors, step).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    total, most2, size = rows.agg(F.count("*"), F.max("norm2"), F.max(F.octet_length("vec"))).first()
    if most2 is not None and most2 >= 2.0**50:
        raise ValueError("vectors of a squared norm of 2^50 steps or more")
    anchors = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("row", "anchor")
    n_anchors = anchors.count()
    dim = max((size or 0) // 4, 1)
    sample = [tuple(r) for r in rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vec_id", "label", "vec").collect()]
    n_cells = min(max(int(total**0.5) // 4, 1), MOST_CELLS)
    cells = Cells(sample, dim, most2 or 0.0, n_cells, min(max(int(n_anchors**0.5) // 4, 1), n_cells))
    if not sample:
        cells.pivots = np.zeros((1, dim + 1))
    cells.radius = radii(rows, spark.sparkContext.broadcast(cells), len(cells.pivots))
    sent = spark.sparkContext.broadcast(cells)
    whole = F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    same = nearest(rows, anchors.withColumn("limits", whole), sent, total, positives, True)
    # products are whole numbers: so the limits are the whole numbers within the percents
    limit = F.struct(F.ceil(low * F.col("score") / 100).cast("double").alias("low"), F.floor(high * F.col("score") / 100).cast("double").alias("high"), "rank", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    listed = common.written(same.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", limit.alias("l"))))["l"].alias("limits")), "negatives-limits")
    pairs = anchors.join(listed.select("anchor", F.transform("limits", lambda p: F.struct(p["low"].alias("low"), p["high"].alias("high"))).alias("limits")), "anchor")
    other = nearest(rows, pairs, sent, total, negatives, False)
    named = listed.join(anchors.select("anchor", "vec_id"), "anchor").select("anchor", "vec_id", F.posexplode("limits").alias("nth", "p"))
    out = named.join(other, ["anchor", "nth"])
    return out.select(F.col("vec_id").alias("anchor_id"), "p.positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "p.positive_score", F.col("score").alias("negative_score"))


def radii(rows: DataFrame, sent, n_cells: int) -> np.ndarray:
    """The greatest distance of a row from the pivot of its cell, for each cell; -inf for one without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, most = sent.value, np.full(n_cells, -np.inf)
        for batch in batches:
            vecs = batch.column(0).to_pylist()
            for at in range(0, len(vecs), BLOCK_ROWS):
                d = cells.distances(cells.augmented(_matrix(vecs[at : at + BLOCK_ROWS], cells.dim)), n_cells)
                np.maximum.at(most, d.argmin(1), d.min(1))
        yield _batch([(int(c), float(most[c])) for c in np.flatnonzero(most > -np.inf)], "cell int, radius double")

    out = np.full(n_cells, -np.inf)
    for r in rows.select("vec").mapInArrow(run, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        out[r["cell"]] = r["radius"]
    return out


def relabelled(vectors: DataFrame) -> DataFrame:
    """The labels of the query: the next of ten where the id is divisible by 7."""
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long")).alias("label"))


def hard_negatives_sql() -> str:
    """The query over the table embeddings in DuckDB's SQL."""
    return """
    WITH good AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
        SELECT a.vec_id AS a, a.label = b.label AS same, b.vec_id AS b, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
        FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (SELECT a, b AS p, s AS ps FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
    SELECT p.a AS anchor_id, p.p AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.b AS negative_id, p.ps AS positive_score, n.s AS negative_score
    FROM positives p JOIN scored n ON p.a = n.a AND NOT n.same AND 30 * p.ps <= 100 * n.s AND 100 * n.s <= 90 * p.ps
    WINDOW w AS (PARTITION BY p.a, p.p ORDER BY n.s DESC, n.b)
    QUALIFY row_number() OVER w <= 10
    """
