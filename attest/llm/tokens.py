"""Token counts of documents from flat token files, by a scan for separators.

A token file is nothing but ids of two bytes (four, if the vocabulary needs them), each document followed by the
end-of-document id. Tasks read blocks of a file and search them for that id with numpy; a window over the blocks
of a file then carries the place of the last separator and the number of separators across block borders,
so documents that span blocks are counted whole.

Defined results: a null or empty text has 0 tokens; repeated rows and null ids are counted each; an empty table
gives an empty result; other columns are ignored. Trailing ids without a separator are no document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import scratch_path
from .archives import Reader, Writer
from .bpe import PATTERN, coder
from .common import dealt, materialised

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_ID = 50256
FILE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20


def id_type(end_id: int) -> np.dtype:
    return np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")


def written(docs: DataFrame, folder: str, path: str = RANKS, pattern: str = PATTERN, end_id: int = END_ID, limit: int = FILE_BYTES) -> DataFrame:
    """Writes the token files; (doc_id, file, ordinal, file_bytes) per row, where file_bytes is the file's size so far."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, ordinal, kind = Writer(folder, ".tokens", limit), None, 0, id_type(end_id)
        for batch in batches:
            rows, texts = [], (x.as_py() or "" for x in batch.column(1))
            for doc_id, ids in zip(batch.column(0), coder(path, pattern).encode(texts)):
                name, _ = out.append(np.array([*ids, end_id], dtype=kind).tobytes())
                ordinal, last = (ordinal + 1 if name == last else 0), name
                rows.append((doc_id.as_py(), name, ordinal, out.size))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                             names=["doc_id", "file", "ordinal", "file_bytes"])
        out.close()
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(write, "doc_id bigint, file string, ordinal bigint, file_bytes bigint")


def separators(files: DataFrame, folder: str, end_id: int = END_ID, block: int = BLOCK_BYTES) -> DataFrame:
    """(file, start, places) per block of (file, file_bytes): the places of the separators, in ids from the file's start."""
    blocks = files.select("file", "file_bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("file_bytes") - 1, F.lit(block).cast("bigint"))).alias("start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, kind = Reader(folder), id_type(end_id)
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(reader.read(row["file"], row["start"], min(block, row["file_bytes"] - row["start"])), dtype=kind)
                places = np.flatnonzero(data == end_id) + row["start"] // kind.itemsize
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]], pa.string()), pa.array([row["start"]], pa.int64()), pa.array([places], pa.list_(pa.int64()))],
                    names=["file", "start", "places"])
    return dealt(blocks).mapInArrow(scan, "file string, start bigint, places array<bigint>")


def counts(found: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) per document, from the separators of the blocks."""
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    carried = found.select(
        "file", "places",
        F.coalesce(F.sum(F.size("places")).over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.max(F.array_max("places")).over(earlier), F.lit(-1)).alias("last_before"))
    size = lambda p, i: p - F.when(i > 0, F.get("places", i - 1)).otherwise(F.col("last_before")) - 1
    return carried.select("file", "n_before", F.posexplode(F.transform("places", size)).alias("i", "n_tokens")).select(
        "file", (F.col("n_before") + F.col("i")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) per row of ``docs``, read off the token files."""
    folder = scratch_path(docs.sparkSession, "tokens")
    index = materialised(written(docs, folder), "token-index")
    files = index.groupBy("file").agg(F.max("file_bytes").alias("file_bytes"))
    return index.select("doc_id", "file", "ordinal").join(counts(materialised(separators(files, folder), "separators")), ["file", "ordinal"]).select("doc_id", "n_tokens")
