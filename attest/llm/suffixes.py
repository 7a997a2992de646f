"""Removal of repeated passages: bytes covered by a string of 50 bytes that starts in a document of smaller id too.

Prefix doubling over positions chosen by content. A position's rank at 20, 35 and 50 bytes comes from a pair of
ranks at an offset; after each length Spark sorts the ranks and positions whose rank no other document has drop
out; the threshold ends the doubling. Not every position needs a rank at the first length: of the 31 parts of 20
bytes in a 50-byte window the one of least rank is its anchor, and equal windows have equal anchors, so one
position in some 15 stands for all windows around it.

The rounds: (1) anchors' ranks, kept if two documents have them; (2) for these, the rank of all bytes their windows
cover, which settles the inside of a copied passage at once, and the ranks of the 35 bytes to the left and to the
right; (3) where a half occurs in different surroundings, the 50-byte ranks of the windows that hold it. Ranks that
decide on a removal have 96 bits.

Texts are cut into chunk files in the shared folder once, and every round works chunk by chunk: what a chunk holds
several times is merged before it is shuffled, so a passage that a third of all documents share is one row per
chunk, and what comes back to a chunk is bounded by its size.

Defined results: null and empty texts have no bytes; rows without an id are left as they are and remove nothing; rows
that share an id don't remove each other's bytes; repeated rows get the same result each; an empty table gives an
empty result; other columns pass through, those that bear a name the operator adds are replaced.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import release_since, scratch, scratch_path
from .anchors import LENGTH, SLICE, STEP, anchored, half_ranks, joined, part_ranks, window_ranks
from .archives import opened
from .common import dealt, materialised

CHUNK_BYTES = 8 << 20
LEFT, RIGHT = np.uint64(0), np.uint64(1)
WHOLE, HALF = 0, 1
REPLY = "kind int, x bigint, y bigint, first bigint"
RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def signed(ranks: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(ranks).view(np.int64))


class Chunk:
    """The rows of one chunk file and their texts as one array of bytes."""

    def __init__(self, folder: str, chunk: int, doc_id: str, text: str):
        system, path = opened(folder)
        with system.open_input_file(f"{path}/{chunk}.arrow") as file:
            self.rows = pa.ipc.open_stream(file.read()).read_all().combine_chunks()
        texts = self.rows.column(text).cast(pa.large_binary()).fill_null(b"").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_binary())
        sizes = np.array([len(x) for x in (v.as_buffer() for v in texts)], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.data = np.frombuffer(b"".join(v.as_buffer() for v in texts), dtype=np.uint8)
        ids = self.rows.column(doc_id)
        self.skipped = ids.is_null().to_numpy().astype(bool)
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)

    def doc(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, places, side="right")]

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors' ranks, 48 bits of them, and their documents."""
        found = [(rank[anchor], at + first) for at, rank, first, _, anchor in anchored(self.data, self.ends, self.skipped)]
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ranks, firsts = (np.concatenate(x) for x in zip(*found))
        return ranks >> np.uint64(16), self.doc(firsts)

    def halves(self) -> np.ndarray:
        """The ranks of all 35-byte windows."""
        half = np.zeros(max(len(self.data), 1), np.uint64)
        for at in range(0, len(self.data) - LENGTH + 1, SLICE):
            part = half_ranks(part_ranks(self.data[at:at + SLICE + LENGTH - 1]))
            half[at:at + len(part)] = part
        return half

    def runs(self) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Per anchor: its rank, first and last window, document, the rank of all bytes they cover, the ranks of the
        halves (with ``has_left`` and ``has_right``: whether some window holds them) and the window between them.
        With these the ranks of all 35-byte windows."""
        half = np.zeros(max(len(self.data), 1), np.uint64)
        found = []
        for at, rank, first, last, anchor in anchored(self.data, self.ends, self.skipped):
            part = half_ranks(rank)
            half[at:at + len(part)] = part
            found.append((rank[anchor] >> np.uint64(16), at + first, at + last, at + anchor))
        names = ("rank", "first", "last", "anchor")
        runs = dict(zip(names, (np.concatenate(x) for x in zip(*found)))) if found else {n: np.zeros(0, np.uint64 if n == "rank" else np.int64) for n in names}
        first, last, anchor = runs["first"], runs["last"], runs.pop("anchor")
        middle = anchor - STEP
        shape = ((last - first) << 8 | (anchor - first)).astype(np.uint64)
        has_left, has_right = first <= middle, last >= middle
        runs |= {
            "whole": joined(joined(window_ranks(half, first)[0], window_ranks(half, last)[0]), shape), "middle": middle,
            "left": joined(half[np.where(has_left, middle, first)], LEFT) >> np.uint64(24), "right": joined(half[np.where(has_right, anchor, first)], RIGHT) >> np.uint64(24),
            "has_left": has_left, "has_right": has_right, "doc": self.doc(first)}
        # A second word for the run, beside ``whole``.
        runs["check"] = joined(half[first], joined(half[last + STEP], shape)) >> np.uint64(32)
        return runs, half


def smallest(key: np.ndarray, check: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its (key, check), and for each of these the row with the smallest document."""
    order = np.argsort(key)
    number = np.empty(len(order), np.int64)
    if not len(order):
        return number, order
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(new)
    if len(starts) < len(order):
        # Rows of keys that are found more often are put in order of check and document.
        often = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        some = order[often]
        order[often] = some[np.lexsort((docs[some], check[some], key[some]))]
        new[1:] |= check[order[1:]] != check[order[:-1]]
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def lookup(keys: tuple[np.ndarray, np.ndarray], known: tuple[np.ndarray, np.ndarray], values: np.ndarray, default: np.ndarray) -> np.ndarray:
    """Value of each (x, y) among the known ones, or the default."""
    order = np.argsort(known[0])
    x, y = known[0][order], known[1][order]
    low, high = np.searchsorted(x, keys[0], "left"), np.searchsorted(x, keys[0], "right")
    out = default.copy()
    # Equal x with different y are next to each other; as a rule there is one.
    for step in range(int((high - low).max(initial=0))):
        at = np.flatnonzero(low + step < high)
        at = at[y[low[at] + step] == keys[1][at]]
        out[at] = values[order][low[at] + step]
    return out


class Settled:
    """What the second round settles in a chunk: windows that lie in a run some smaller document has, and windows
    that still need their own ranks: those that hold a half found in different surroundings, where the first
    document with the run has it. Both are kept as spans of windows in a small file beside the chunk's."""

    def __init__(self, gone: np.ndarray, open_: np.ndarray):
        self.gone, self.open = gone, open_

    @classmethod
    def of(cls, chunk: Chunk, replies: pa.Table) -> tuple[Settled, np.ndarray]:
        """With the ranks of the chunk's halves."""
        runs, half = chunk.runs()
        kind = replies.column("kind").to_numpy()
        x, y = (replies.column(c).to_numpy().view(np.uint64) for c in "xy")
        first = replies.column("first").to_numpy(zero_copy_only=False)
        number, rows = smallest(runs["whole"], runs["check"], runs["doc"])
        local, whole = runs["doc"][rows], kind == WHOLE
        least = np.minimum(local, lookup((runs["whole"][rows], runs["check"][rows]), (x[whole], y[whole]), first[whole], local))[number]
        halves = np.unique(x[kind == HALF])
        # Every place where the first document has the run, not one of them.
        owner = runs["doc"] == least
        left = owner & runs["has_left"] & np.isin(runs["left"], halves)
        right = owner & runs["has_right"] & np.isin(runs["right"], halves)
        low = np.where(left, runs["first"], np.maximum(runs["first"], runs["middle"]))
        high = np.where(right, runs["last"], np.minimum(runs["last"], runs["middle"]))
        some, gone = (left | right) & (low <= high), ~owner
        return cls(np.stack([runs["first"][gone], runs["last"][gone]]), np.stack([low[some], high[some]])), half

    def windows(self, chunk: Chunk, half: np.ndarray):
        """Starts, two ranks and documents of the open windows, and per distinct window its number and first row."""
        low, counts = self.open[0], self.open[1] - self.open[0] + 1
        starts = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        x, y = window_ranks(half, starts)
        docs = chunk.doc(starts)
        return starts, x, y, docs, *smallest(x, y, docs)

    def removed(self, chunk: Chunk, replies: pa.Table) -> np.ndarray:
        """Which bytes a window of a smaller document covers."""
        low, high = self.gone
        if self.open.size:
            starts, x, y, docs, number, rows = self.windows(chunk, chunk.halves())
            known = tuple(replies.column(c).to_numpy().view(np.uint64) for c in "xy")
            local = docs[rows]
            least = np.minimum(local, lookup((x[rows], y[rows]), known, replies.column("first").to_numpy(zero_copy_only=False), local))[number]
            late = starts[docs > least]
            low, high = np.concatenate([low, late]), np.concatenate([high, late])
        marks = np.zeros(len(chunk.data) + 1, dtype=np.int32)
        np.add.at(marks, low, 1)
        np.add.at(marks, high + LENGTH, -1)
        return np.cumsum(marks)[:-1] > 0

    def save(self, folder: str, chunk: int) -> None:
        system, path = opened(folder)
        out = io.BytesIO()
        np.savez_compressed(out, gone=self.gone, open=self.open)
        # A task that runs again replaces the file by an equal one, whole at any moment.
        fresh = f"{path}/{uuid.uuid4().hex}.part"
        with system.open_output_stream(fresh) as file:
            file.write(out.getvalue())
        system.move(fresh, f"{path}/{chunk}.settled")

    @classmethod
    def load(cls, folder: str, chunk: int) -> Settled:
        system, path = opened(folder)
        with system.open_input_file(f"{path}/{chunk}.settled") as file:
            found = np.load(io.BytesIO(file.read()))
        return cls(found["gone"], found["open"])


def stored(docs: DataFrame, folder: str, text: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """Writes the rows of ``docs`` into chunk files; (chunk) per file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path)
        held, size, names = [], 0, []

        def close():
            name = uuid.uuid4().int >> 66
            out = io.BytesIO()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(pa.Table.from_batches(held).combine_chunks())
            with system.open_output_stream(f"{path}/{name}.arrow") as file:
                file.write(out.getvalue())
            names.append(name)

        for batch in batches:
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)])
            start = 0
            while start < batch.num_rows:
                room = np.cumsum(sizes[start:]) + size
                stop = start + max(int(np.searchsorted(room, limit)), 0 if held else 1)
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    size += int(sizes[start:stop].sum())
                if stop < batch.num_rows:
                    close()
                    held, size = [], 0
                start = stop
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64())], names=["chunk"])
    return docs.mapInArrow(write, "chunk bigint")


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept_sha256; with the kept bytes as text if asked (characters
    that a removal cuts in two go whole), else without the text."""
    docs = docs.drop(*RESULT).withColumn(doc_id, F.col(doc_id).cast("bigint"))
    mark = len(scratch())
    folder = scratch_path(docs.sparkSession, "chunks")
    chunks = materialised(stored(docs, folder, text, chunk_bytes), "chunk-names")

    def rank_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("chunk").to_pylist():
                ranks, where = Chunk(folder, name, doc_id, text).ranks()
                number, rows = smallest(ranks, np.zeros(len(ranks), np.uint64), where)
                highest = np.full(len(rows), np.iinfo(np.int64).min)
                np.maximum.at(highest, number, where)
                # The chunk and, in the last place, whether the rank is found in two documents of the chunk.
                code = name * 2 + (where[rows] < highest)
                yield pa.RecordBatch.from_arrays([signed(ranks[rows]), pa.array(code, pa.int64())], names=["rank", "code"])

    def rank_runs(key: tuple[pa.Scalar, ...], replies: pa.Table) -> pa.Table:
        name = key[0].as_py()
        runs, _ = Chunk(folder, name, doc_id, text).runs()
        live = np.isin(runs["rank"], replies.column("rank").to_numpy().view(np.uint64))
        runs = {k: v[live] for k, v in runs.items()}
        _, rows = smallest(runs["whole"], runs["check"], runs["doc"])
        parts = [(WHOLE, runs["whole"][rows], runs["check"][rows], runs["doc"][rows])]
        for side in ("left", "right"):
            has = runs[f"has_{side}"][rows]
            half, whole = runs[side][rows][has], runs["whole"][rows][has] >> np.uint64(16)
            order = np.lexsort((whole, half))
            half, whole = half[order], whole[order]
            # The least and the greatest surroundings of a half in this chunk tell whether it has several.
            ends = np.ones(len(half), dtype=bool)
            ends[1:-1] = (half[1:-1] != half[:-2]) | (half[1:-1] != half[2:])
            parts.append((HALF, half[ends], whole[ends], np.zeros(int(ends.sum()), np.int64)))
        n = [len(p[1]) for p in parts]
        columns = [np.repeat([p[0] for p in parts], n).astype(np.int32), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))]
        return pa.table([pa.array(columns[0]), signed(columns[1]), signed(columns[2]), pa.array(columns[3]), pa.array(np.full(sum(n), name, np.int64))],
                        names=["kind", "x", "y", "first", "chunk"])

    def rank_windows(key: tuple[pa.Scalar, ...], left: pa.Table, replies: pa.Table) -> pa.Table:
        name = key[0].as_py()
        chunk = Chunk(folder, name, doc_id, text)
        known, half = Settled.of(chunk, replies)
        known.save(folder, name)
        _, x, y, docs, _, rows = known.windows(chunk, half)
        return pa.table([signed(x[rows]), signed(y[rows]), pa.array(docs[rows]), pa.array(np.full(len(rows), name, np.int64))], names=["x", "y", "first", "chunk"])

    others = [c for c in docs.columns if c != text]
    fields = [*(docs.schema[c] for c in others), *([T.StructField(text, T.StringType())] if with_text else []),
              *[T.StructField(c, T.LongType()) for c in RESULT[:3]], T.StructField(RESULT[3], T.StringType())]

    def finish(key: tuple[pa.Scalar, ...], left: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(folder, key[0].as_py(), doc_id, text)
        gone = Settled.load(folder, key[0].as_py()).removed(chunk, replies)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        starts = np.concatenate([[0], chunk.ends[:-1]]).astype(np.int64)[:len(chunk.ends)]
        inner = starts[(starts < len(gone)) & (chunk.ends > starts)]
        begins[inner] = gone[inner]
        totals = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins)]
        n_removed, n_spans = (t[chunk.ends] - t[starts] for t in totals)
        keep = [chunk.data[a:b][~gone[a:b]].tobytes() if n else chunk.data[a:b].tobytes() for a, b, n in zip(starts, chunk.ends, n_removed)]
        out = {c: chunk.rows.column(c) for c in others}
        if with_text:
            had = chunk.rows.column(text).is_valid().to_pylist()
            out[text] = pa.array([k.decode("utf-8", "ignore") if h else None for k, h in zip(keep, had)], pa.string())
        out |= {"n_bytes": pa.array(chunk.ends - starts), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in keep], pa.string())}
        return pa.table(out)

    # Each round is written before the next reads it, so that its shuffle files can go.
    every = W.partitionBy("rank")
    shared = materialised(
        dealt(chunks).mapInArrow(rank_anchors, "rank bigint, code bigint")
        .withColumn("n", F.count(F.lit(1)).over(every)).withColumn("twice", F.max(F.col("code") % 2).over(every))
        .filter("n > 1 or twice = 1").select(F.shiftright("code", 1).alias("chunk"), "rank"), "ranks")
    # A run comes back where another chunk has it; a half where its surroundings differ. Rows of one key are at most
    # one or two per chunk.
    same = W.partitionBy("kind", "x", "z")
    replies = materialised(
        shared.groupBy("chunk").applyInArrow(rank_runs, f"{REPLY}, chunk bigint")
        .withColumn("z", F.when(F.col("kind") == WHOLE, F.col("y")))
        .withColumn("n", F.count(F.lit(1)).over(same)).withColumn("least", F.min("first").over(same))
        .withColumn("low", F.min("y").over(same)).withColumn("high", F.max("y").over(same))
        .filter(F.when(F.col("kind") == WHOLE, F.col("n") > 1).otherwise(F.col("low") < F.col("high")))
        .select("kind", "x", F.when(F.col("kind") == WHOLE, F.col("y")).otherwise(F.lit(0)).alias("y"), F.col("least").alias("first"), "chunk"), "runs")
    both = W.partitionBy("x", "y")
    found = materialised(
        chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(rank_windows, "x bigint, y bigint, first bigint, chunk bigint")
        .withColumn("n", F.count(F.lit(1)).over(both)).withColumn("first", F.min("first").over(both)).filter("n > 1").drop("n"), "windows")
    release_since(mark, ("chunks", "chunk-names", "windows"))
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, T.StructType(fields))


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the repeated bytes, with the columns of ``docs``."""
    return removed(docs, text=text, with_text=True).select(*docs.columns)
