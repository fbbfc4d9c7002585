"""Operator 10: a quality score by a factorisation machine over hashed words, structure and length.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The sum-of-squares identity scores all pairwise interactions in time linear in a text's features. Features of the
whole text: its lower-cased words, hashed to 2^13 columns and scaled to unit length; statistics of its structure
(shares of symbols, capitals, digits, breaks, repeated words and lines, word length), each as a few soft bins; and,
as metadata, its length.

Training takes a bounded sample, at most `per_class` rows of either label, least hash first, made into features where
the texts are; only those come to the driver. Labels, lang, source and doc_id are never features.

Edge cases: null counts as empty, and empty texts are scored by their statistics; null labels are not learnt from; of
several labels of a doc_id the least counts; without labels of both kinds every score is 0.5; repeated rows get equal
results; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, BINS, RANK = 1 << 13, 12, 6
_CLASSES = [re.compile(p) for p in (r"[#*$%&|<>]", r"[!?]", r"[0-9]", r"[A-ZÀ-Þ]", r"[.,;:]", r"\n", r"[^\W\d_]")]
STATS = len(_CLASSES) + 6
COLUMNS = WORDS + STATS * BINS + 1


class Hasher:
    """Words to columns, with a bounded memory of words seen."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def columns(self, words: list[str]) -> np.ndarray:
        seen, out = self.seen, []
        for w in words:
            c = seen.get(w)
            if c is None:
                if len(seen) > 200_000:
                    seen.clear()
                c = seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS
            out.append(c)
        return np.array(out, np.int64)


def statistics(text: str, words: list[str]) -> list[float]:
    """STATS numbers between 0 and 1."""
    n, k = max(len(text), 1), max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    out = [len(p.findall(text)) / n for p in _CLASSES]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out += [len(set(words)) / k, same / k, len(set(lines)) / max(len(lines), 1), min(len(text) / k / 20, 1), min(k / max(len(lines), 1) / 200, 1), min(np.log1p(len(text)) / 14, 1)]
    return out


def features(text: str | None, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a whole text, columns ascending."""
    text = text or ""
    words = text.lower().split()
    cols, n = np.unique(hasher.columns(words), return_counts=True) if words else (np.zeros(0, np.int64), np.zeros(0))
    value = np.log1p(n)
    value = value / max(float(np.sqrt((value**2).sum())), 1e-9)
    # square roots spread small shares; triangular bins make a statistic piecewise linear
    s = np.sqrt(np.clip(statistics(text, words), 0, 1)) * (BINS - 1)
    low = np.minimum(s.astype(np.int64), BINS - 2)
    base = WORDS + np.arange(STATS) * BINS + low
    cols = np.concatenate([cols, np.stack([base, base + 1], 1).ravel(), [COLUMNS - 1]])
    value = np.concatenate([value, np.stack([1 - (s - low), s - low], 1).ravel(), [1.0]])
    return cols, value


class FactorMachine:
    def __init__(self, seed: int = 1) -> None:
        self.w = np.zeros(COLUMNS)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (COLUMNS, RANK))

    def raw(self, cols: np.ndarray, vals: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and the sums over v x, for rows that begin at `at` in cols and vals; each row has features."""
        vx = self.v[cols] * vals[:, None]
        s = np.add.reduceat(vx, at, axis=0)
        return np.add.reduceat(self.w[cols] * vals, at) + 0.5 * ((s**2).sum(1) - np.add.reduceat((vx**2).sum(1), at)), s

    def score(self, cols: np.ndarray, vals: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(cols, vals, at)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 2e-5, seed: int = 2) -> FactorMachine:
        r = np.random.default_rng(seed)
        sw, sv = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for i in range(0, len(rows), batch):
                pick = order[i : i + batch]
                cols, vals = np.concatenate([rows[k][0] for k in pick]), np.concatenate([rows[k][1] for k in pick])
                sizes = np.array([len(rows[k][0]) for k in pick])
                at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                z, s = self.raw(cols, vals, at)
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
                dr, row = np.repeat(d, sizes), np.repeat(np.arange(len(pick)), sizes)
                used, inv = np.unique(cols, return_inverse=True)
                gw = np.bincount(inv, dr * vals) + decay * self.w[used]
                gv = dr[:, None] * vals[:, None] * (s[row] - self.v[cols] * vals[:, None])
                gv = np.stack([np.bincount(inv, gv[:, f]) for f in range(RANK)], 1) + decay * self.v[used]
                sw[used] += gw**2
                sv[used] += gv**2
                self.w[used] -= rate * gw / np.sqrt(sw[used])
                self.v[used] -= rate * 0.5 * gv / np.sqrt(sv[used])
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 4, held_out: int = 2, per_class: int = 2500, seed: int = 9) -> FactorMachine | None:
    """Fits on labelled rows outside the held-out fold: at most per_class of either label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(common.remainder("doc_id", fold) != held_out).groupBy("doc_id").agg(F.min("y").alias("y"))
    picked = common.seeded_sample(known, "y", per_class, 2, seed).select("doc_id", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            made = [features(t.as_py(), hasher) for t in batch.column(2)]
            cols = pa.array([m[0] for m in made], pa.list_(pa.int32()))
            vals = pa.array([m[1] for m in made], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cols, vals], names=["doc_id", "y", "cols", "vals"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    # One row per id, however many repeat it: that of the least hash.
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = rows.mapInArrow(run, "doc_id long, y int, cols array<int>, vals array<float>").toArrow().sort_by("doc_id")
    y = sample.column("y").to_numpy()
    if len(np.unique(y)) < 2:
        return None
    cols, vals = sample.column("cols").combine_chunks(), sample.column("vals").combine_chunks()
    made = [(cols[i].values.to_numpy().astype(np.int64), vals[i].values.to_numpy().astype(np.float64)) for i in range(len(y))]
    return FactorMachine().fit(made, y)


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, fold: int = 4, held_out: int = 2, **options) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold=fold, held_out=held_out, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = sent.value, Hasher()
        for batch in batches:
            out: list[float] = []
            held: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = 0
            for value in batch.column(1) if m else ():
                held.append(features(value.as_py(), hasher))
                waiting += len(held[-1][0])
                if waiting > 100_000:
                    out += _scores(m, held)
                    held, waiting = [], 0
            out += _scores(m, held) if held else []
            out = out if m else [0.5] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", (common.remainder("doc_id", fold) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scores(m: FactorMachine, held: list) -> list[float]:
    at = np.concatenate([[0], np.cumsum([len(h[0]) for h in held])[:-1]])
    return m.score(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), at).tolist()
