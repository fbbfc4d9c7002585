"""Operator 9: language identification by a small convolutional network over bytes.

Windows of 128 bytes go through a byte embedding, filters of three widths, max pooling, ReLU and a softmax layer;
trained in numpy with Adam, applied to every window of every text, whatever its length. A document's prediction is
the mean of its windows' probabilities, weighted by their bytes.

As embedding and filter are both linear, each filter column is folded with the embedding into a table of 256 rows
before scoring: a window's responses are sums of table rows, without a matrix product per byte.

Training takes a bounded sample: of each of the `max_languages` most frequent languages at most `per_language` rows,
least hash first, and of each `windows_per_doc` windows at seeded places of the whole text. Scoring takes only the text.

Edge cases: a text that is null or has no letter is `und` with score 0; without labelled rows everything is; repeated
rows get equal results; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, DIM, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 12
#: A letter of any script; numerals such as halves and Roman ones are none.
_LETTER = regex.compile(r"\p{L}")


class ByteCnn:
    def __init__(self, classes: list[str], seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"emb": r.normal(0, 0.5, (256, DIM)), "out": r.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(classes))), "ob": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p |= {f"f{w}": r.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)), f"b{w}": np.zeros(FILTERS)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, x: np.ndarray) -> tuple:
        """Probabilities, pooled values, and where each filter had its maximum."""
        p, e = self.p, self.p["emb"][x]
        pooled, where = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            stacked = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
            r = stacked @ p[f"f{w}"]
            where.append(r.argmax(1))
            pooled.append(r.max(1) + p[f"b{w}"])
        h = np.concatenate(pooled, axis=1)
        return softmax(np.maximum(h, 0) @ p["out"] + p["ob"]), h, where

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> ByteCnn:
        r, p = np.random.default_rng(seed), self.p
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                b = x[order[i : i + batch]]
                q, h, where = self._forward(b)
                d = q
                d[np.arange(len(b)), y[order[i : i + batch]]] -= 1
                d /= len(b)
                g = {"out": np.maximum(h, 0).T @ d, "ob": d.sum(0), "emb": np.zeros_like(p["emb"])}
                dh = (d @ p["out"].T) * (h > 0)
                for k, w in enumerate(WIDTHS):
                    dk, at = dh[:, k * FILTERS : (k + 1) * FILTERS], where[k]
                    # only the byte stretch of each maximum has a gradient
                    took = b[np.arange(len(b))[:, None, None], at[:, :, None] + np.arange(w)]
                    e = p["emb"][took].reshape(len(b), FILTERS, w * DIM)
                    g[f"f{w}"] = np.einsum("bf,bfk->kf", dk, e)
                    g[f"b{w}"] = dk.sum(0)
                    de = (dk[:, :, None] * p[f"f{w}"].T[None]).reshape(-1, DIM)
                    np.add.at(g["emb"], took.reshape(-1), de)
                step += 1
                for key in p:
                    m[key] = 0.9 * m[key] + 0.1 * g[key]
                    s[key] = 0.999 * s[key] + 0.001 * g[key] ** 2
                    p[key] = (p[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(s[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict[int, list[np.ndarray]]:
        return {w: [np.ascontiguousarray(self.p["emb"] @ self.p[f"f{w}"][j * DIM : (j + 1) * DIM]) for j in range(w)] for w in WIDTHS}

    def windows(self, x: np.ndarray, tables: dict) -> np.ndarray:
        """Class probabilities of windows (n, WINDOW)."""
        out = []
        for i in range(0, len(x), 64):
            b = x[i : i + 64]
            pooled = []
            for w in WIDTHS:
                n = b.shape[1] - w + 1
                r = tables[w][0][b[:, :n]]
                for j in range(1, w):
                    r += tables[w][j][b[:, j : j + n]]
                pooled.append(r.max(1) + self.p[f"b{w}"])
            out.append(softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.p["out"] + self.p["ob"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last filled up with byte 0, and the bytes of text in each."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = -(-len(raw) // WINDOW)
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(raw)] = raw
    size = np.full(n, WINDOW)
    size[-1] = len(raw) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), size


def train(docs: DataFrame, fold: int = 5, per_language: int = 700, windows_per_doc: int = 4, max_languages: int = 256, seed: int = 7) -> ByteCnn | None:
    """Fits on rows whose fold remainder is not 0; at most per_language * windows_per_doc windows a language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (common.remainder("doc_id", fold) != 0))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # The rows are picked without their texts; the bounded set of ids and hashes then picks the texts, each once.
    keys = ["lang", "doc_id", "h"]
    picked = common.seeded_sample(rows.select(*keys).distinct(), "lang", per_language, max_languages, seed, ("doc_id", "h")).select(*keys)
    at = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "doc_id"), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1
    cuts = F.array(*[F.col("text").substr(F.lit(1) if k == 0 else at(k), F.lit(WINDOW)) for k in range(windows_per_doc)])
    sample = rows.join(F.broadcast(picked), keys).select(*keys, cuts.alias("cuts")).groupBy(*keys).agg(F.min("cuts").alias("cuts")).orderBy("doc_id", "lang", "h").collect()
    if not sample:
        return None
    classes = sorted({r["lang"] for r in sample})
    x, y = [], []
    for r in sample:
        for c in r["cuts"]:
            x.append(cut(c)[0][0] if c else np.zeros(WINDOW, np.uint8))
            y.append(classes.index(r["lang"]))
    return ByteCnn(classes).fit(np.stack(x), np.array(y), epochs=max(4, min(40, 40_000 // len(x))))


def languages_of(model: ByteCnn, tables: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and its score for each text of a batch; windows of many texts go through the network together."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    waiting = 0

    def settle() -> None:
        x = np.concatenate([h[1] for h in held])
        weighted = model.windows(x, tables) * np.concatenate([h[2] for h in held])[:, None]
        at = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])[:-1]])
        sums = np.add.reduceat(weighted, at, axis=0)
        for (i, _, _), total in zip(held, sums, strict=True):
            q = total / total.sum()
            lang[i], score[i] = model.classes[int(q.argmax())], min(max(float(q.max()), 0.0), 1.0)
        held.clear()

    for i, value in enumerate(texts):
        text = value.as_py()
        if model and text and _LETTER.search(text):
            held.append((i, *cut(text)))
            waiting += len(held[-1][1])
            if waiting >= 2048:
                settle()
                waiting = 0
    if held:
        settle()
    return lang, score


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        tables = m.tables() if m else {}
        for batch in batches:
            lang, score = languages_of(m, tables, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, fold: int = 5, **options) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score."""
    found = predict(docs, train(docs, fold, **options))
    return found.select("doc_id", (common.remainder("doc_id", fold) == 0).alias("held_out"), "lang_pred", "score")


def in_a_language(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """docs whose text is in a learned language with a score of at least `least`; the whole rows stay as they are."""
    model, names = train(docs, **options), docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        tables = m.tables() if m else {}
        for batch in batches:
            lang, score = languages_of(m, tables, batch.column(at))
            yield batch.filter(pa.array((np.array(lang) != "und") & (score >= least)))

    return docs.mapInArrow(keep, docs.schema)
