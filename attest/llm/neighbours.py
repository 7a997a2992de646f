"""Nearest neighbours by cosine: randomly rotated one-bit codes choose the vectors that are compared exactly.

A unit vector is rotated and stored as the signs of its components, with one correction scalar, the inner product
of the rotated vector and its signs' unit vector. Packed bits and scalar estimate the inner product with a rotated
query, and a bound on the error follows from the scalar. In each block of the index the vectors with a query's highest
estimates are compared exactly first, and the k-th best of them sets the mark; all whose upper bound reaches it are then reranked
with the original components in doubles.

Every row is indexed. Queries are streamed in blocks from a written table, so a task holds one block of vectors
and one of queries. Results leave a task as k rows per query and block, then meet in a top-k per query.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
with a null id; vectors are compared with those of their own length; rows that share the query's id are not its
candidates; repeated queries count once; repeated candidates are each found; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import scratch_path
from .archives import opened

SEED = 17
# Standard deviations of the estimate that the error bound spans.
SPAN = 2.5
ROWS, QUERIES, PAIRS = 16384, 1024, 1 << 18
# Vectors per query, in multiples of k, that set the mark.
FIRST = 4
INDEX = "vec_id bigint, dim int, norm double, code binary, align double, embedding array<double>"


@functools.cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def index(vectors: DataFrame, seed: int = SEED) -> DataFrame:
    """The index table: id, code, correction scalar, norm and the vector itself."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    usable = (F.size(F.col("embedding")) > 0) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(parts, lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(usable).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").alias("dim"), parts.alias("embedding"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_dim(batch):
                x = matrix(part.column("embedding"), dim)
                # Scaled by the largest component first, so that squares neither overflow nor vanish.
                top = np.abs(x).max(axis=1)
                norm = np.sqrt(np.square(x / top[:, None]).sum(axis=1)) * top
                turned = (x / norm[:, None]) @ rotation(dim, seed).T
                signs = turned > 0
                align = np.abs(turned).sum(axis=1) / np.sqrt(dim)
                codes = [row.tobytes() for row in np.packbits(signs, axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("dim"), pa.array(norm), pa.array(codes, pa.binary()), pa.array(align), part.column("embedding")],
                    names=["vec_id", "dim", "norm", "code", "align", "embedding"])
    return rows.mapInArrow(code, INDEX)


def cosines(x: dict, q: dict, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact cosines of pairs of vector and query, in doubles."""
    score = np.empty(len(rows))
    for at in range(0, len(rows), PAIRS):
        i, j = rows[at:at + PAIRS], columns[at:at + PAIRS]
        score[at:at + PAIRS] = (x["vectors"][i] * q["vectors"][j]).sum(axis=1) / (x["norm"][i] * q["norm"][j])
    return score


def marks(x: dict, q: dict, estimate: np.ndarray, k: int) -> np.ndarray:
    """Per query a cosine that k vectors of the block reach: the k-th best of those with the highest estimates."""
    few = min(FIRST * k, len(estimate))
    if few < k:
        return np.full(estimate.shape[1], -np.inf)
    first = np.argpartition(estimate, len(estimate) - few, axis=0)[-few:]
    columns = np.broadcast_to(np.arange(estimate.shape[1]), first.shape)
    exact = cosines(x, q, first.ravel(), columns.ravel()).reshape(first.shape)
    exact[np.isneginf(np.take_along_axis(estimate, first, 0))] = -np.inf
    return np.partition(exact, few - k, axis=0)[few - k]


def searched(x: dict, q: dict, k: int, span: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block of vectors the best ``k`` for each of a block of queries: query place, vector place, cosine."""
    dim = x["vectors"].shape[1]
    estimate = (x["signs"] @ q["turned"].T) / (np.sqrt(dim) * x["align"].astype(np.float32)[:, None])
    spread = (span * np.sqrt(np.maximum(1 - x["align"] ** 2, 0)) / (x["align"] * np.sqrt(max(dim - 1, 1e-9)))).astype(np.float32)
    estimate[x["ids"][:, None] == q["ids"][None, :]] = -np.inf
    # The mark is rounded down, so that a vector that ties with it in doubles stays.
    mark = np.nextafter((marks(x, q, estimate, k) - 1e-6).astype(np.float32), np.float32(-np.inf))
    rows, columns = np.nonzero((estimate + spread[:, None] >= mark) & (estimate > -np.inf))
    score = cosines(x, q, rows, columns)
    order = np.lexsort((x["ids"][rows], -score, columns))
    rows, columns, score = rows[order], columns[order], score[order]
    place = np.arange(len(columns)) - np.searchsorted(columns, columns)
    best = place < k
    return columns[best], rows[best], score[best]


def search(indexed: DataFrame, queries: DataFrame, k: int, seed: int = SEED, span: float = SPAN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of the index for each row of ``queries``, itself index rows."""
    spark = indexed.sparkSession
    folder = scratch_path(spark, "queries")
    queries.dropDuplicates(["vec_id"]).select("vec_id", "dim", "norm", "embedding").write.parquet(folder)

    def vectors(batch: pa.RecordBatch, dim: int) -> dict:
        return {"ids": batch.column("vec_id").to_numpy(), "norm": batch.column("norm").to_numpy(), "vectors": matrix(batch.column("embedding"), dim)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        asked = ds.dataset(path, filesystem=system, format="parquet")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for dim, part in by_dim(batch.slice(at, ROWS)):
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                    x = vectors(part, dim) | {"align": part.column("align").to_numpy()}
                    x["signs"] = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
                    for block in asked.to_batches(batch_size=QUERIES, filter=ds.field("dim") == dim, use_threads=False, fragment_readahead=0, batch_readahead=0):
                        if not block.num_rows:
                            continue
                        q = vectors(block, dim)
                        q["turned"] = ((q["vectors"] / q["norm"][:, None]) @ rotation(dim, seed).T).astype(np.float32)
                        j, i, score = searched(x, q, k, span)
                        yield pa.RecordBatch.from_arrays([pa.array(q["ids"][j]), pa.array(x["ids"][i]), pa.array(score)], names=["query_id", "vec_id", "score"])
    found = indexed.select("vec_id", "dim", "norm", "code", "align", "embedding").mapInArrow(scan, "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
