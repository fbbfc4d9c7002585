"""Nearest vectors by cosine through an inverted index of cells, filtered by metadata, or exactly over all cells.

Centroids are fitted on a bounded sample; every vector is indexed under its nearest one. A query looks into the cells
nearest to it. How many, is set by the sample: the fewest with which its own rows find the wanted share of their
neighbours. Without structure in the vectors that is most of the cells, with it a few.

Index and queries are packed by cell, and packs of one cell are joined and multiplied in tasks; so queries are never
gathered on the driver, and a cell of any size is many packs. Each task sends on its best k per query alone. Vectors of
unequal length are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.conditions import condition

#: Rows that the fit may see, bounds of the number of cells, rows in a pack of vectors and of queries.
SAMPLE, LEAST_CELLS, MOST_CELLS, PACK, QUERY_PACK = 20_000, 4, 2048, 4096, 1024


class Cells(NamedTuple):
    """Centroids (at most MOST_CELLS), and how many cells a query looks into."""

    centroids: np.ndarray
    probes: int


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _usable(vectors: DataFrame, embedding: str) -> DataFrame:
    """Rows whose vector has components, all of them finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, finite))


def fit(vectors: DataFrame, *, ident: str = "vec_id", embedding: str = "embedding", recall: float = 0.95, k: int = 10, rounds: int = 8) -> Cells:
    """Centroids by k-means on the SAMPLE rows of least hash, and the probes that give the recall among these rows."""
    rows = _usable(vectors, embedding)
    total = rows.count()
    taken = rows.orderBy(F.xxhash64(ident), ident).limit(SAMPLE).select(embedding).collect()
    if not taken:
        return Cells(np.zeros((1, 1)), 1)
    x = unit(np.array([r[0] for r in taken], np.float64))
    n = int(min(max(total**0.5 / 2, LEAST_CELLS), MOST_CELLS, len(x)))
    centroids = x[:n].copy()
    for _ in range(rounds):
        cell = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        held = np.bincount(cell, minlength=n) > 0
        centroids[held] = unit(sums[held])
    cell = (x @ centroids.T).argmax(1)
    asked = x[: min(256, len(x))]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    if not near.size:
        return Cells(centroids, n)
    places = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return Cells(centroids, int(places[min(int(np.ceil(recall * len(places))), len(places)) - 1]) + 1)


def index(vectors: DataFrame, cells: Cells, *, embedding: str = "embedding") -> DataFrame:
    """vectors with `cell`, the nearest centroid's number; rows without a usable vector are left out. Written once, clustered by cell, it serves all searches."""
    return _with_cells(_usable(vectors, embedding), cells, embedding, 1, "cell")


def _with_cells(rows: DataFrame, cells: Cells, embedding: str, probes: int, name: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(cells.centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = unit(np.array(b[embedding].tolist(), np.float64).reshape(len(b), -1)) if len(b) else np.zeros((0, 1))
            c = sent.value
            # without a sample there is one cell, for vectors of any size
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32) if c.shape[1] == x.shape[1] else np.zeros((len(b), probes), np.int32)
            yield b.assign(**{name: list(near) if probes > 1 else near[:, 0]})

    kind = "array<int>" if probes > 1 else "int"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, {name} {kind}")


def search(indexed: DataFrame, queries: DataFrame, cells: Cells, k: int, *, where: dict | None = None, exact: bool = False, ident: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): of indexed rows that fulfil `where`, the k nearest to each of queries (query_id, embedding).

    exact looks into all cells. Similarities are rounded to nine digits; of equals the lesser id comes first.
    """
    probes = len(cells.centroids) if exact else min(cells.probes, len(cells.centroids))
    asked = _with_cells(_usable(queries.select("query_id", embedding), embedding), cells, embedding, probes, "cells")
    asked = asked.withColumn("cell", F.explode("cells") if probes > 1 else F.col("cells"))
    rows = indexed.where(condition(where)).select("cell", ident, embedding)
    left, right = _packed(rows, ident, PACK, "ids", "vectors", embedding), _packed(asked.select("cell", "query_id", embedding), "query_id", QUERY_PACK, "query_ids", "query_vectors", embedding)
    dim = cells.centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                ids, x = np.array(row.ids), unit(np.array(row.vectors.tolist(), np.float64).reshape(-1, dim))
                asked_ids, q = np.array(row.query_ids), unit(np.array(row.query_vectors.tolist(), np.float64).reshape(-1, dim))
                s = np.round(q @ x.T, 9)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                m = order.shape[1]
                yield pd.DataFrame({"query_id": np.repeat(asked_ids, m), "id": ids[order].ravel(), "similarity": np.take_along_axis(s, order, 1).ravel()})

    found = left.join(right, "cell").select("ids", "vectors", "query_ids", "query_vectors").mapInPandas(run, "query_id long, id long, similarity double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def _packed(rows: DataFrame, ident: str, size: int, ids: str, vectors: str, embedding: str) -> DataFrame:
    """(cell, ids, vectors): about `size` rows of a cell in each row; a cell's rows are dealt by their hash."""
    counts = rows.groupBy("cell").agg(F.count("*").alias("_n"))  # at most one row per cell
    dealt = rows.join(F.broadcast(counts), "cell").withColumn("_p", F.pmod(F.xxhash64(ident), F.ceil(F.col("_n") / size)))
    return dealt.groupBy("cell", "_p").agg(F.collect_list(F.struct(F.col(ident).cast("long").alias("i"), F.col(embedding).alias("v"))).alias("r")).select("cell", F.col("r")["i"].alias(ids), F.col("r")["v"].alias(vectors))
