"""Vector codes: each vector is cut into equal parts and each part becomes the number of its nearest codebook entry, with
codebooks fitted by dual-tree Lloyd rounds in whole numbers.

Tasks hold blocks of vectors. For each part position a block has a tree over its parts, built once and kept beside them:
halves by the widest side of the box, the same number of parts in each half. Each round builds a tree over the entries of
each position and walks both down together: a pair of nodes goes when the least distance between their boxes is above
the largest distance to a box that stays. A node with one entry left is assigned whole, its sum and number read off running
sums; leaves that keep several entries compare distances in whole numbers. Tasks return sums and numbers per
entry, so a round gathers one row per entry and position, whatever the number of vectors.

Defined results: a component x becomes floor(256 * x), held within +-2^28; vectors that are null or hold null or non-finite
components are left out; the length is that of the longest vector, filled up to a multiple of the number of parts, and
shorter vectors are filled with zeros. Codebooks start from the rows of the smallest vec_ids (null last, repeated rows in
order of their components), fewer where the table has fewer; distances that tie go to the lower entry; entries without
parts stay. Rows without an id or label and repeated rows are coded each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialised
from .sparse import bounds, spread

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 28
# Vectors of a block, and parts in a leaf of its trees.
BLOCK = 1 << 14
LEAF = 16


def usable(vector: Column) -> Column:
    """Not null, and no component is null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector.cast("array<double>"), finite), F.lit(False))


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of each component, one row per vector, filled with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, spread(np.zeros(len(sizes), np.int64), sizes)] = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return out


def node_bounds(n: int, depth: int) -> list[np.ndarray]:
    """Borders of the nodes of each level over n places in tree order; node i of a level has the nodes 2i and 2i + 1 below it."""
    finest = (np.arange((1 << depth) + 1, dtype=np.int64) * n) >> depth
    return [finest[:: 1 << (depth - level)] for level in range(depth + 1)]


def tree_order(points: np.ndarray, depth: int) -> np.ndarray:
    """The points' order in the tree: each node is sorted by its widest side and halved."""
    order = np.arange(len(points))
    for level in node_bounds(len(points), depth)[:-1]:
        sizes = np.diff(level)
        there = sizes > 0
        sorted_points = points[order]
        low, high = (f.reduceat(sorted_points, level[:-1][there]) for f in (np.minimum, np.maximum))
        node = np.repeat(np.arange(int(there.sum())), sizes[there])
        side = np.argmax(high - low, axis=1)[node]
        order = order[np.lexsort((np.take_along_axis(sorted_points, side[:, None], 1)[:, 0], node))]
    return order


@dataclass
class Tree:
    """Points in tree order, and per level the borders and boxes of the nodes; an empty node has no use for its box."""
    order: np.ndarray
    points: np.ndarray
    levels: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    running: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, depth: int, order: np.ndarray | None = None) -> "Tree":
        order = tree_order(points, depth) if order is None else order
        points, levels = points[order], node_bounds(len(points), depth)
        finest = levels[-1]
        there = np.diff(finest) > 0
        far = 4 * LARGEST
        low, high = np.full((len(there), points.shape[1]), far), np.full((len(there), points.shape[1]), -far)
        low[there], high[there] = (f.reduceat(points, finest[:-1][there]) for f in (np.minimum, np.maximum))
        lows, highs = [low], [high]
        for _ in range(depth):
            lows.insert(0, np.minimum(lows[0][0::2], lows[0][1::2]))
            highs.insert(0, np.maximum(highs[0][0::2], highs[0][1::2]))
        return cls(order, points, levels, lows, highs, np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)]))


@dataclass
class Assigned:
    """What one walk leaves: the entry of each point in tree order, and sums and numbers of points per entry."""
    entry: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    in_whole_nodes: int


def dual_tree(parts: Tree, entries: Tree) -> Assigned:
    """The nearest entry of every part; ties go to the lower entry."""
    n, k = len(parts.points), len(entries.points)
    found = Assigned(np.zeros(n, np.int64), np.zeros((k, parts.points.shape[1]), np.int64), np.zeros(k, np.int64), 0)
    depth_p, depth_e = len(parts.levels) - 1, len(entries.levels) - 1
    p, e, at_p, at_e = np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64), 0, 0
    while len(p):
        low_p, high_p, low_e, high_e = parts.low[at_p][p], parts.high[at_p][p], entries.low[at_e][e], entries.high[at_e][e]
        gap = np.maximum(np.maximum(low_p - high_e, low_e - high_p), 0)
        reach = np.maximum(high_p - low_e, high_e - low_p)
        nearest, farthest = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        sizes = np.diff(np.append(heads, len(p)))
        stays = nearest <= np.repeat(np.minimum.reduceat(farthest, heads), sizes)
        p, e = p[stays], e[stays]
        if at_e == depth_e:
            heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            alone = np.diff(np.append(heads, len(p))) == 1
            whole, its_entry = p[heads[alone]], entries.order[entries.levels[-1][e[heads[alone]]]]
            start, end = parts.levels[at_p][whole], parts.levels[at_p][whole + 1]
            np.add.at(found.sums, its_entry, parts.running[end] - parts.running[start])
            np.add.at(found.counts, its_entry, end - start)
            found.entry[spread(start, end - start)] = np.repeat(its_entry, end - start)
            found.in_whole_nodes += int((end - start).sum())
            rest = np.repeat(~alone, np.diff(np.append(heads, len(p))))
            p, e = p[rest], e[rest]
            if at_p == depth_p:
                compare(parts, entries, p, e, found)
                return found
        if at_p < depth_p:
            p, e, at_p = np.stack([2 * p, 2 * p + 1], axis=1).ravel(), np.repeat(e, 2), at_p + 1
        if at_e < depth_e:
            p, e, at_e = np.repeat(p, 2), np.stack([2 * e, 2 * e + 1], axis=1).ravel(), at_e + 1
            filled = entries.levels[at_e][e] < entries.levels[at_e][e + 1]
            p, e = p[filled], e[filled]
        order = np.argsort(p, kind="stable")
        p, e = p[order], e[order]
    return found


def compare(parts: Tree, entries: Tree, p: np.ndarray, e: np.ndarray, found: Assigned) -> None:
    """Distances in whole numbers between the points of leaves and the entries they keep."""
    if not len(p):
        return
    entry = entries.order[entries.levels[-1][e]]
    order = np.lexsort((entry, p))
    p, entry = p[order], entry[order]
    heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    kept = np.diff(np.append(heads, len(p)))
    start, end = parts.levels[-1][p[heads]], parts.levels[-1][p[heads] + 1]
    # One run per point: the entries that its leaf keeps.
    point, of_leaf = spread(start, end - start), np.repeat(np.arange(len(heads)), end - start)
    run = kept[of_leaf]
    candidate = entry[spread(heads[of_leaf], run)]
    centre = np.zeros_like(entries.points)
    centre[entries.order] = entries.points
    apart = np.repeat(parts.points[point], run, axis=0) - centre[candidate]
    distance = (apart * apart).sum(axis=1)
    starts = bounds(run)[:-1]
    least = np.repeat(np.minimum.reduceat(distance, starts), run)
    nearest = np.minimum.reduceat(np.where(distance == least, candidate, len(centre)), starts)
    found.entry[point] = nearest
    np.add.at(found.sums, nearest, parts.points[point])
    np.add.at(found.counts, nearest, 1)


def depth_for(n: int, leaf: int) -> int:
    """Levels below the root, so that a leaf holds ``leaf`` to twice as many."""
    return max(n // leaf, 1).bit_length() - 1


def entry_trees(books: np.ndarray) -> list[Tree]:
    """A tree per position over entries (positions x entries x components), one entry or none to a leaf."""
    return [Tree.over(book, (max(len(book), 1) - 1).bit_length()) for book in books]


def blocks(vectors: DataFrame, width: int, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """(ids, labels, numbers, orders) per block of (id, label, vector): whole numbers and the tree order of each position."""
    def cut(ids: list, labels: list, held: list[np.ndarray]) -> pa.RecordBatch:
        numbers = np.concatenate(held)
        depth, size = depth_for(len(numbers), LEAF), width // parts
        orders = np.stack([tree_order(numbers[:, i * size:(i + 1) * size], depth) for i in range(parts)])
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([numbers.astype("<i4").tobytes()]),
             pa.array([orders.astype("<i4").tobytes()])], names=["ids", "labels", "numbers", "orders"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                piece = batch.slice(at, block)
                if len(ids) + piece.num_rows > block:
                    yield cut(ids, labels, held)
                    ids, labels, held = [], [], []
                ids.extend(piece.column(0).to_pylist())
                labels.extend(piece.column(1).to_pylist())
                held.append(whole_numbers(piece.column(2), width))
        if ids:
            yield cut(ids, labels, held)
    return vectors.mapInArrow(gather, "ids array<bigint>, labels array<string>, numbers binary, orders binary")


def read_block(row: dict, width: int, parts: int) -> tuple[np.ndarray, list[Tree]]:
    numbers = np.frombuffer(row["numbers"], "<i4").reshape(-1, width).astype(np.int64)
    orders = np.frombuffer(row["orders"], "<i4").reshape(parts, -1).astype(np.int64)
    size, depth = width // parts, depth_for(len(numbers), LEAF)
    return numbers, [Tree.over(numbers[:, i * size:(i + 1) * size], depth, orders[i]) for i in range(parts)]


def lloyd_round(held: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the blocks."""
    parts, entries, size = books.shape

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sums, counts = entry_trees(books), np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for i, tree in enumerate(read_block(row, parts * size, parts)[1]):
                    found = dual_tree(tree, trees[i])
                    sums[i] += found.sums
                    counts[i] += found.counts
        part, entry = np.nonzero(counts)
        place = np.tile(np.arange(size), len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, size)), pa.array(np.repeat(entry, size)), pa.array(place), pa.array(sums[part, entry].ravel()),
             pa.array(np.repeat(counts[part, entry], size))], names=["part", "entry", "place", "total", "n"])

    # One row per position, entry and component comes to the driver: the size of the codebooks.
    totals = (held.select("numbers", "orders").mapInArrow(walk, "part bigint, entry bigint, place bigint, total bigint, n bigint")
              .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())
    out = books.copy()
    for row in totals:
        out[row["part"], row["entry"], row["place"]] = row["total"] // row["n"]
    return out


def codes_of(held: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) per vector of the blocks."""
    parts, entries, size = books.shape

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = entry_trees(books)
        for batch in batches:
            for row in batch.to_pylist():
                numbers, by_part = read_block(row, parts * size, parts)
                code, error = np.zeros((len(numbers), parts), np.uint8), np.zeros(len(numbers), np.int64)
                for i, tree in enumerate(by_part):
                    entry = np.zeros(len(numbers), np.int64)
                    entry[tree.order] = dual_tree(tree, trees[i]).entry
                    apart = numbers[:, i * size:(i + 1) * size] - books[i][entry]
                    code[:, i], error = entry, error + (apart * apart).sum(axis=1)
                text = code.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()),
                     pa.array([text[j:j + 2 * parts] for j in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"])
    return held.mapInArrow(walk, "vec_id bigint, label string, code string, error bigint")


def first_books(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the first vectors by id (positions x entries x components)."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    numbers = whole_numbers(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), width)
    return numbers.reshape(len(rows), parts, width // parts).transpose(1, 0, 2).copy()


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) per usable vector, and the codebooks. ``vectors`` has vec_id, label and the vector."""
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    width = -(-max(longest or 0, 1) // parts) * parts
    books = first_books(kept, width, parts, entries)
    held = materialised(blocks(kept, width, parts, block), "blocks")
    for _ in range(rounds if books.shape[1] else 0):
        books = lloyd_round(held, books)
    return codes_of(held, books), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Coded vectors with label_error, the errors of all vectors of their label added up; null is a label. Sums are taken
    per label before any shuffle, and vectors and sums meet under 16 spread keys, so a label of a third of the vectors is split."""
    coded = materialised(coded, "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("of_spread"))
    keyed = coded.withColumn("spread", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(16)).cast("int"))
    return keyed.join(sums, (F.col("spread") == F.col("of_spread")) & F.col("label").eqNullSafe(F.col("of_label"))).drop("spread", "of_spread", "of_label")
