"""Retrieval: exact vector top-k, name candidates by trigrams, tiers of matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

#: Vectors of a batch that meet a block of queries in one product.
AT_ONCE = 512


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, *, ident: str = "vec_id", embedding: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of all vectors by cosine, exactly.

    Queries are a stated set, taken in blocks of at most about `block` rows, which bounds what is broadcast; every
    block scans the vectors once as matrix products, AT_ONCE vectors at a time, and each batch sends on only its own k
    best per query.
    """
    n = queries.count()
    parts = max(1, -(-n // block))
    found = None
    for p in range(parts):
        rows = queries.where(F.pmod(F.xxhash64(ident), F.lit(parts)) == p).select(ident, embedding).orderBy(ident).collect()
        if not rows:
            continue
        ids, q = np.array([r[0] for r in rows]), _unit(np.array([r[1] for r in rows], dtype=np.float64))
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for b in batches:
                x = _unit(np.stack(b[embedding].to_numpy()).astype(np.float64)) if len(b) else np.zeros((0, q.shape[1]))
                own, s = nearest(q, x, b[ident].to_numpy(), k)
                yield pd.DataFrame({"query_id": np.repeat(ids, s.shape[1]), "id": own.ravel(), "similarity": s.ravel()})

        part = vectors.select(ident, embedding).mapInPandas(run, "query_id long, id long, similarity double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, id long, similarity double")
    w = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and products of the k best rows of x for each row of q, equal ones by id; only AT_ONCE columns of products exist at a time."""
    ids, best = np.zeros((len(q), 0), dtype=own.dtype), np.zeros((len(q), 0))
    for i in range(0, len(x), AT_ONCE):
        best = np.hstack([best, np.round(q @ x[i : i + AT_ONCE].T, 9)])
        ids = np.hstack([ids, np.broadcast_to(own[i : i + AT_ONCE], (len(q), len(own[i : i + AT_ONCE])))])
        order = np.lexsort((ids, -best), axis=1)[:, :k]
        ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
    return ids, best


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def trigram_matches(candidates: DataFrame, names: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """(candidate, name, similarity): pairs of at least the threshold, by an equi-join on trigrams.

    Each text goes by its rarest trigrams alone: of n it needs n - ceil(threshold * n) + 1, since a pair that reaches
    the threshold has one of these in common. So the commonest trigrams, which most texts have, join nothing. Pairs
    whose sizes rule them out go before the sets are compared.
    """
    sets = lambda df, c: df.select(c).distinct().withColumn("g", T.word_trigrams(F.col(c))).where(F.size("g") > 0)
    a, b = sets(candidates, "candidate"), sets(names, "name")
    often = a.select(F.explode("g").alias("t")).unionByName(b.select(F.explode("g").alias("t"))).groupBy("t").agg(F.count("*").alias("often"))

    def rarest(df: DataFrame, c: str) -> DataFrame:
        one = df.select(c, "g", F.explode("g").alias("t")).join(often, "t")
        r = F.row_number().over(W.partitionBy(c).orderBy("often", "t"))
        need = F.size("g") - F.ceil(F.size("g") * F.lit(threshold) - 1e-9) + 1
        return one.withColumn("r", r).where(F.col("r") <= need).select(c, F.col("g").alias(f"g_{c}"), "t")

    pairs = rarest(a, "candidate").join(rarest(b, "name"), "t")
    n, m = F.size("g_candidate"), F.size("g_name")
    pairs = pairs.where(F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9).dropDuplicates(["candidate", "name"])
    return pairs.select("candidate", "name", T.jaccard(F.col("g_candidate"), F.col("g_name")).alias("similarity")).where(F.col("similarity") >= threshold)


def best_match(matches: DataFrame) -> DataFrame:
    """The best name of each candidate; of equals the longer, then the lesser."""
    w = W.partitionBy("candidate").orderBy(F.col("similarity").desc(), F.length("name").desc(), "name")
    return matches.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def resolve(mentions: DataFrame, names: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """(candidate, key, method, score): an exact key first, else the best likeness; two equal bests give none.

    mentions has candidate, names has key and name. An exact but ambiguous name never falls to likeness.
    """
    keyed = names.select("key", "name", T.company_key(F.col("name")).alias("k"))
    m = mentions.select("candidate").distinct().withColumn("k", T.company_key(F.col("candidate")))
    exact = m.join(keyed, "k").groupBy("candidate").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key"))
    sure = exact.where("n = 1").select("candidate", "key", F.lit("exact").alias("method"), F.lit(1.0).alias("score"))
    rest = m.join(exact, "candidate", "left_anti")
    near = trigram_matches(rest, names, threshold=threshold).join(names.select("key", "name"), "name")
    top = near.withColumn("_r", F.rank().over(W.partitionBy("candidate").orderBy(F.col("similarity").desc()))).where("_r = 1")
    fuzzy = top.groupBy("candidate").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.max("similarity").alias("score")).where("n = 1")
    return sure.unionByName(fuzzy.select("candidate", "key", F.lit("fuzzy").alias("method"), "score"))


def search_tiers(names: DataFrame, q: str, limit: int) -> DataFrame:
    """Names that hold q, exact before prefix before inside, shorter first; a filter that keeps its top-k."""
    low, n = q.lower(), F.lower("name")
    tier = F.when(n == low, 0).when(n.startswith(low), 1).otherwise(2)
    return names.where(n.contains(low)).withColumn("tier", tier).orderBy("tier", F.length("name"), "name", "key").limit(limit)
