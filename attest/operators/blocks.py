"""Exact top-k of queries against a corpus, in blocks.

Few queries (checked size) go to every task; many are cut into a grid of query blocks and corpus
shards that meet in one task each. Either way a block yields at most k rows per query, and one
row_number over those gives the result. Scores are rounded to ten digits so that copies of one
document tie, and ties go to the smaller document id, whatever the order of summation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .topk import top_k

BROADCAST_QUERIES = 4096
BROADCAST_CELLS = 4_000_000
QUERY_BLOCK = 4096
SHARD = 20_000
CELLS = 4_000_000
DIGITS = 10


def _best(scores: np.ndarray, ids: np.ndarray, k: int):
    """Row indices of the k best of one score column: score down, id up."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.flatnonzero(scores > -np.inf)
    keep = keep[scores[keep] > -np.inf]
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _frame(scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    parts = []
    for j, q in enumerate(query_ids):
        column = scores[:, j]
        best = _best(column, ids, k)
        parts.append(pd.DataFrame({"query_id": q, "doc_id": ids[best], "score": column[best]}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})


def _mask(scores: np.ndarray, docs: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    """Exclude documents without a concept of the query, for queries that have concepts."""
    if "concepts" not in docs.columns:
        return scores
    names = pd.Index(sorted({c for cs in queries["concepts"] for c in cs}))

    def indicator(frame):
        out = np.zeros((len(frame), len(names)))
        for i, cs in enumerate(frame["concepts"]):
            found = names.get_indexer(list(cs)) if len(cs) and len(names) else np.array([], dtype=int)
            out[i, found[found >= 0]] = 1.0
        return out
    q = indicator(queries)
    overlap = indicator(docs) @ q.T
    open_query = q.sum(axis=1) == 0
    return np.where((overlap > 0) | open_query[None, :], scores, -np.inf)


def _sliced(docs: pd.DataFrame, queries: pd.DataFrame, k: int, score: Callable[[pd.DataFrame], np.ndarray]) -> pd.DataFrame:
    """Scores slices of the documents, so that a matrix of documents x queries has at most CELLS cells, and keeps k per query."""
    step, best = max(1, CELLS // max(1, len(queries))), None
    for start in range(0, len(docs), step):
        part = docs.iloc[start:start + step]
        scores = _mask(np.round(score(part), DIGITS) + 0.0, part, queries)
        found = _frame(scores, part["doc_id"].to_numpy(), queries["query_id"].to_numpy(), k)
        best = found if best is None else _trim(pd.concat([best, found]), k)
    return _frame(np.zeros((0, 0)), np.zeros(0), np.zeros(0), k) if best is None else best


def dense_block(docs: pd.DataFrame, queries: pd.DataFrame, k: int, epsilon: float = 0.0) -> pd.DataFrame:
    """Inner products over the product of the lengths plus ``epsilon``; 0 for null, empty and zero vectors."""
    width = max([len(v) for v in [*docs["vector"], *queries["vector"]] if v is not None], default=0)

    def matrix(column):
        return np.stack([np.zeros(width) if v is None or not len(v) else np.asarray(v, dtype=np.float64) for v in column])

    def unit(m):
        n = np.linalg.norm(m, axis=1)
        return n, m / np.where(n == 0, 1.0, n)[:, None]
    q_norm, q = unit(matrix(queries["vector"]))

    def score(part):
        d_norm, d = unit(matrix(part["vector"]))
        scores = d @ q.T
        if epsilon:
            product = d_norm[:, None] * q_norm[None, :]
            scores *= product / (product + epsilon)
        return scores
    return _sliced(docs, queries, k, score)


def sparse_block(docs: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Inner products of sparse vectors: each term of a document meets the queries that ask for it."""
    def flat(column):
        filled = [v for v in column if v is not None and len(v)]
        return np.concatenate(filled) if filled else np.zeros(0)

    def sizes(column):
        return [0 if v is None else len(v) for v in column]
    names = pd.Index(sorted({t for ts in queries["terms"] if ts is not None for t in ts}))
    term = names.get_indexer(flat(queries["terms"]))
    order = np.argsort(term, kind="stable")
    asking = np.repeat(np.arange(len(queries)), sizes(queries["terms"]))[order]
    weight = flat(queries["weights"])[order]
    starts = np.searchsorted(term[order], np.arange(len(names) + 1))

    def score(part):
        at = names.get_indexer(flat(part["terms"]))
        known = at >= 0
        row, at, w = np.repeat(np.arange(len(part)), sizes(part["terms"]))[known], at[known], flat(part["weights"])[known]
        fan = starts[at + 1] - starts[at]
        met = np.repeat(starts[at], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        cell = np.repeat(row, fan) * len(queries) + asking[met]
        return np.bincount(cell, np.repeat(w, fan) * weight[met], len(part) * len(queries)).reshape(len(part), len(queries))
    return _sliced(docs, queries, k, score)


def nearest(spark, docs: DataFrame, queries: DataFrame, k: int,
            block: Callable[[pd.DataFrame, pd.DataFrame, int], pd.DataFrame],
            broadcast_queries: int = BROADCAST_QUERIES, shard: int = SHARD) -> DataFrame:
    """Top k documents per query: (query_id, rnk, doc_id, score)."""
    if k < 1:
        raise ValueError("k must be positive")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, " \
             f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    payload = F.size("terms") if "terms" in queries.columns else F.size("vector")
    n, cells = queries.agg(F.count("*"), F.coalesce(F.sum(payload), F.lit(0))).first()
    if n <= broadcast_queries and cells <= BROADCAST_CELLS:
        shared = spark.sparkContext.broadcast(queries.toPandas())

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                if not len(batch):
                    continue
                found = block(batch, shared.value, k)
                best = found if best is None else pd.concat([best, found])
                if len(best) > 8 * k * max(1, n):
                    best = _trim(best, k)
            if best is not None and len(best):
                yield _trim(best, k)
        hits = docs.mapInPandas(local, schema)
    else:
        # A block of queries is bounded by its number and by the terms or components it holds.
        n_blocks = max(1, math.ceil(n / QUERY_BLOCK), math.ceil(cells / BROADCAST_CELLS))
        n_shards = max(1, math.ceil(docs.count() / shard))
        left = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards).cast("bigint"))).withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
        right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks).cast("bigint"))).withColumn(
            "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_shards - 1).cast("bigint"))))

        def meet(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(d) or not len(q):
                return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
            return block(d, q, k)
        hits = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(meet, schema)
    return top_k(hits, k, ["query_id"], [F.desc("score"), F.asc("doc_id")]).select("query_id", "rnk", "doc_id", "score")


def _trim(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = hits.sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)
