"""Quality classifier: logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader updates.

A text is a sparse vector: n-grams of one and two words, and of one to three word shapes (runs of capitals, small letters and
digits become one mark each, other characters stay; a word equal to the one before has a shape of its own), each
hashed to one of 2^18 buckets with 1 + log of its count, the whole at length one, and a bucket that every text has. A score
is the logistic of the sparse dot product with the weights.

Labels are learnt from at most ``SAMPLE`` documents of each label, those with the smallest hashes of their ids, each weighed so that
the labels keep their shares of all labelled documents. Their vectors are written to the shared folder in the order of the
hashes; each epoch is one pass of one task over them, batch by batch, so its memory is the state of 2^18 buckets.

Defined results: words are cut at white space and texts are taken whole; a null text is an empty one and scores what the common
bucket says. A document without an id is not held out and has no label. Of labels that differ for one id the more frequent
counts, then 1; null labels are none; of the texts of one id the smallest is learnt. Without any label all scores are
0.5. Repeated rows are scored each; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialised
from .sparse import bounds

BITS = 18
SAMPLE = 8_000
EPOCHS = 3
# Step, its damping, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
# Texts are worked on in groups of about so many code points; words kept per Python worker.
GROUP = 1 << 20
KEPT_WORDS = 300_000

CAPITALS, SMALL, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"a+"), re.compile(r"\d+")
# Odd multipliers of the n-grams of words and of shapes, by length.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
AGAIN = np.uint64(xxhash.xxh64_intdigest(b"the word before"))


def shape(word: str) -> str:
    letters = CAPITALS.sub(lambda m: "".join("A" if g else "a" for g, _ in itertools.groupby(m.group(), str.isupper)), word)
    return DIGITS.sub("9", letters)


class Words:
    """Hashes of words and of their shapes; one per Python worker."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.hashes, self.shapes = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def of(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.place) > KEPT_WORDS:
            self.clear()
        new = [w for w in set().union(*texts) if w not in self.place]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        digest = lambda words: np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(new))
        self.hashes, self.shapes = np.concatenate([self.hashes, digest(new)]), np.concatenate([self.shapes, digest(map(shape, new))])
        return np.fromiter(itertools.chain.from_iterable(map(self.place.__getitem__, t) for t in texts), np.int64, sum(map(len, texts)))


@functools.cache
def words() -> Words:
    return Words()


def grams(hashes: np.ndarray, text: np.ndarray, lengths: tuple[int, ...], kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the n-grams that lie in one text."""
    mixed = hashes
    for n in range(1, max(lengths) + 1):
        if n > 1:
            mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint64(29))) * MIX[0] + hashes[n - 1:]
        inside = text[: len(mixed)] == text[n - 1:]
        if n in lengths:
            spun = (mixed ^ (mixed >> np.uint64(32))) * MIX[kind + n - 1]
            yield text[: len(mixed)][inside], (spun[inside] >> np.uint64(64 - BITS)).astype(np.int64)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a group of texts: starts, buckets, values. The last bucket is every text's."""
    cut = [t.split() for t in texts]
    place = words().of(cut)
    text = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    hashes, shapes = words().hashes[place], words().shapes[place]
    same = np.flatnonzero((place[1:] == place[:-1]) & (text[1:] == text[:-1])) + 1
    shapes = shapes.copy()
    shapes[same] = AGAIN
    found = [*grams(hashes, text, (1, 2), 0), *grams(shapes, text, (1, 2, 3), 2)]
    keys = np.concatenate([t * (1 << BITS) + b for t, b in found])
    keys.sort()
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    row, bucket = np.divmod(keys[heads], 1 << BITS)
    value = 1 + np.log(np.diff(np.append(heads, len(keys))))
    sizes = np.bincount(row, minlength=len(texts))
    norm = np.sqrt(np.bincount(row, value * value, len(texts)))
    starts, ends = bounds(sizes + 1), bounds(sizes + 1)[1:] - 1
    buckets, values = np.full(starts[-1], 1 << BITS), np.ones(starts[-1])
    inside = np.ones(starts[-1], bool)
    inside[ends] = False
    buckets[inside], values[inside] = bucket, value / norm[row]
    return starts, buckets, values


def groups_of(texts) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


class Leader:
    """State and updates of the follow-the-regularised-leader rule: sums of gradients, and of their squares, per bucket."""

    def __init__(self, sums: np.ndarray, squares: np.ndarray):
        self.sums, self.squares = sums, squares

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.sums[at], self.squares[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, buckets: np.ndarray, values: np.ndarray, label: float, weight: float) -> None:
        w = self.weights(buckets)
        gradient = weight * (logistic(np.dot(w, values)) - label) * values
        n = self.squares[buckets]
        step = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA
        self.sums[buckets] += gradient - step * w
        self.squares[buckets] += gradient * gradient


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learnt: crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def lessons(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(place, label, weight, text) of the documents to learn from."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").alias("quality")).filter(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    per_id = known.groupBy("doc_id").agg(F.sum(2 * F.col("quality") - 1).alias("votes")).select(
        "doc_id", (F.col("votes") >= 0).cast("int").alias("label"), F.xxhash64("doc_id").alias("place"))
    per_id = materialised(per_id, "labels")
    first = per_id.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("place", "doc_id"))).filter(F.col("rank") <= sample)
    shares = per_id.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    # Two labels at most; ids of the sample are bounded by its size.
    weights = first.groupBy("label").agg(F.count(F.lit(1)).alias("taken")).join(F.broadcast(shares), "label")
    weights = weights.select("label", (F.col("n") / total * F.sum("taken").over(W.partitionBy()) / F.col("taken")).alias("weight"))
    chosen = materialised(first.join(F.broadcast(weights), "label").select(F.col("doc_id").alias("of_id"), "label", "weight", "place"), "sample")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("of_id")).groupBy("of_id", "place", "label", "weight").agg(F.min("text").alias("text")).drop("of_id")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights per bucket, the common one last."""
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in groups_of(batch.column("text").to_pylist()):
                starts, buckets, values = vectors(group)
                keys = batch.slice(at, len(group))
                at += len(group)
                row_lists = [pa.LargeListArray.from_arrays(pa.array(starts), pa.array(x)).cast(pa.list_(t)) for x, t in ((buckets.astype(np.int32), pa.int32()), (values, pa.float64()))]
                yield pa.RecordBatch.from_arrays([keys.column("place"), keys.column("label"), keys.column("weight"), *row_lists],
                                                 names=["place", "label", "weight", "buckets", "values"])
    rows = lessons(docs, labels, sample).mapInArrow(featured, "place bigint, label int, weight double, buckets array<int>, values array<double>")
    held = materialised(rows, "lessons")
    state = Leader(np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1))
    ordered = materialised(held.repartition(1).sortWithinPartitions("place"), "ordered-lessons").coalesce(1)
    for _ in range(epochs):
        state = after_epoch(ordered, state)
    return state.weights()


def after_epoch(ordered: DataFrame, state: Leader) -> Leader:
    """One pass over the lessons in their order; the state of all buckets comes back to the driver."""
    before = state.sums.tobytes(), state.squares.tobytes()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = Leader(*(np.frombuffer(x).copy() for x in before))
        for batch in batches:
            starts = bounds(batch.column("buckets").value_lengths().to_numpy())
            buckets, values = batch.column("buckets").flatten().to_numpy(), batch.column("values").flatten().to_numpy()
            for i, (label, weight) in enumerate(zip(batch.column("label").to_pylist(), batch.column("weight").to_pylist())):
                of_row = slice(starts[i], starts[i + 1])
                leader.learn(buckets[of_row], values[of_row], label, weight)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (leader.sums, leader.squares)], names=["sums", "squares"])
    row = ordered.mapInArrow(learn, "sums binary, squares binary").first()
    return Leader(*(np.frombuffer(bytes(x)).copy() for x in row)) if row else state


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """(doc_id, score) per row of ``docs``."""
    common = weights.astype(np.float32)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [np.zeros(0)]
            for group in groups_of(x.as_py() or "" for x in batch):
                starts, buckets, values = vectors(group)
                out.append(logistic(np.add.reduceat(common[buckets].astype(np.float64) * values, starts[:-1])))
            yield pa.array(np.concatenate(out))
    return docs.select(F.col("doc_id").alias("doc_id"), score(F.col(text)).alias("score"))


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, learnt from ``labels`` (doc_id, quality)."""
    return scored(docs, fitted(docs, labels, sample, epochs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
