"""Removal of repeated passages by prefix doubling over every position, with exact ranks.

The same results as ``suffixes.removed``, by the plain method: (position, rank) pairs of all positions are sorted by Spark at
16, 32 and 50 bytes. The first rank comes from the 16 bytes themselves, each later one from the pair of ranks at an offset; equal
pairs get the name of their first position as new rank. A position whose rank no other document has is unique and drops out, and
with it all longer strings that hold it. No hashes decide. What is sorted is some 30 bytes for each byte of text, which is what
``suffixes`` spares with its anchors; see the README for the figures of both.

A window names a class of equal strings in one task per key, whatever their number; ``suffixes`` merges them per chunk first.

Defined results: as ``suffixes.removed``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .anchors import LENGTH
from .common import fresh, materialised

START, MIDDLE = 16, 32
RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
# Positions that a task emits at once.
SLICE = 1 << 20


def first_ranks(rows: DataFrame, row: str, doc_id: str, text: str) -> DataFrame:
    """(row, at, doc, x, y): the 16 bytes at every position of a text, as two whole numbers."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, doc, value in zip(*(batch.column(c) for c in (row, doc_id, text))):
                data = np.frombuffer(value.as_buffer(), dtype=np.uint8)
                for begin in range(0, len(data) - START + 1, SLICE):
                    part = np.lib.stride_tricks.sliding_window_view(data[begin:begin + SLICE + START - 1], START)
                    pair = np.ascontiguousarray(part).view(np.int64)
                    n = len(pair)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, number.as_py())), pa.array(np.arange(begin, begin + n, dtype=np.int32)), pa.array(np.full(n, doc.as_py())),
                         pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["row", "at", "doc", "x", "y"])
    return rows.select(row, doc_id, text).filter(F.col(doc_id).isNotNull() & (F.octet_length(text) >= LENGTH)).mapInArrow(
        emit, "row bigint, at int, doc bigint, x bigint, y bigint")


def reranked(pairs: DataFrame, *key: str) -> DataFrame:
    """Equal keys get one rank, the name of their first position (rank_row, rank_at), and the smallest document they are found
    in; those that only one document has drop out."""
    same = W.partitionBy(*key)
    return (pairs.withColumn("rank", F.min(F.struct("row", "at")).over(same)).withColumn("least", F.min("doc").over(same)).withColumn("most", F.max("doc").over(same))
            .filter("least < most").select("row", "at", "doc", F.col("rank.row").alias("rank_row"), F.col("rank.at").alias("rank_at"), "least"))


def doubled(ranks: DataFrame, offset: int) -> DataFrame:
    """Positions with their own rank and that of the position ``offset`` bytes on."""
    ahead = ranks.select("row", (F.col("at") - offset).alias("at"), F.col("rank_row").alias("next_row"), F.col("rank_at").alias("next_at"))
    return ranks.select("row", "at", "doc", "rank_row", "rank_at").join(ahead, ["row", "at"])


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_bytes, n_removed, n_spans and kept_sha256."""
    docs = docs.drop(*RESULT).withColumn(doc_id, F.col(doc_id).cast("bigint"))
    row, starts = fresh("row", *docs.columns), fresh("starts", *docs.columns)
    rows = materialised(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    short = materialised(reranked(first_ranks(rows, row, doc_id, text), "x", "y"), "ranks")
    middle = materialised(reranked(doubled(short, MIDDLE - START), "rank_row", "rank_at", "next_row", "next_at"), "ranks")
    full = reranked(doubled(middle, LENGTH - MIDDLE), "rank_row", "rank_at", "next_row", "next_at").filter("doc > least")
    # A text's own positions.
    late = full.groupBy(F.col("row").alias(row)).agg(F.collect_list("at").alias(starts))
    others = [c for c in docs.columns if c != text]
    fields = [*(docs.schema[c] for c in others), *[T.StructField(c, T.LongType()) for c in RESULT[:3]], T.StructField(RESULT[3], T.StringType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = []
            for value, places in zip(batch.column(text), batch.column(starts)):
                data = np.frombuffer((value.as_py() or "").encode(), dtype=np.uint8)
                marks = np.zeros(len(data) + 1, dtype=np.int32)
                if places.is_valid:
                    at = places.values.to_numpy()
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + LENGTH, -1)
                gone = np.cumsum(marks)[:-1] > 0
                begins = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                results.append((len(data), int(gone.sum()), begins, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            columns = list(zip(*results)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                                             names=[*others, *RESULT])
    return rows.join(late, row, "left").select(*others, text, starts).mapInArrow(cut, T.StructType(fields))
