"""Vector codes against a plain Lloyd in whole numbers."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.llm import codes
from attest.llm.catalog import QUERIES

NAMES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def brute(rows, parts=16, n_entries=64, rounds=2):
    """(vec_id, label, vector) rows, all pairs of part and entry."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    if not kept:
        return Counter()
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([[math.floor(256 * c) for c in r[2]] for r in kept], dtype=np.int64).reshape(len(kept), parts, -1)
    books = [x[:n_entries, p].copy() for p in range(parts)]

    def assigned():
        out = []
        for p in range(parts):
            d = ((x[:, p, None, :] - books[p][None]) ** 2).sum(2)
            out.append((d.argmin(1), d.min(1)))
        return out
    for _ in range(rounds):
        for p, (near, _) in enumerate(assigned()):
            for e in set(near.tolist()):
                books[p][e] = x[near == e, p].sum(0) // (near == e).sum()
    final = assigned()
    errors, by_label = sum(d for _, d in final), defaultdict(int)
    for r, e in zip(kept, errors):
        by_label[r[1]] += int(e)
    digest = hashlib.sha256(",".join(str(c) for b in books for entry in b for c in entry).encode()).hexdigest()
    return Counter((r[0], "".join(f"{near[i]:02x}" for near, _ in final), int(errors[i]), by_label[r[1]], digest) for i, r in enumerate(kept))


def found(df):
    return Counter(tuple(r) for r in df.select(*NAMES).collect())


def run(spark, rows, schema="vec_id long, label int, embedding array<float>", **more):
    frame = spark.createDataFrame(rows, schema).repartition(3)
    coded, books = codes.compressed(frame, **more)
    return codes.with_label_errors(coded).withColumn("codebooks_sha256", F.lit(codes.digest(books)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_over_all_vectors(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    assert found(QUERIES["op12_vector_codes"](spark, f"/root/testdata/{sf}")) == brute(rows)


def test_copies_ties_nulls_and_small_tables(spark):
    draw = np.random.default_rng(5)
    grid = [(int(i), int(i) % 3 if i % 4 else None, [float(v) / 256 for v in draw.integers(-2, 3, 32)]) for i in range(300)]
    copies = [(1000 + i, 7, [0.5] * 32) for i in range(400)]
    bad = [(2000, 1, None), (2001, 1, [None] * 32), (2002, 1, [float("nan")] * 32), (2003, 1, [float("inf")] * 32), (None, 1, [0.25] * 32), (5, 1, [0.25] * 32), (5, 1, [0.25] * 32)]
    rows = grid + copies + bad
    assert found(run(spark, rows)) == brute(rows)
    assert found(run(spark, rows, block=50)) == brute(rows)
    for n in (1, 2, 37):
        assert found(run(spark, grid[:n])) == brute(grid[:n])
    assert found(run(spark, [])) == Counter()


def test_lengths_that_differ_are_filled(spark):
    rows = [(1, 1, [0.5] * 17), (2, 1, [0.5]), (3, 2, []), (4, 2, [1e30] * 20)]
    out = {r.vec_id: r for r in run(spark, rows).collect()}
    assert set(out) == {1, 2, 3, 4} and all(r.error == 0 for r in out.values())


def test_extra_columns(spark):
    frame = spark.createDataFrame([(1, 1, [0.5] * 16, "x", 2, "y")], "vec_id long, label int, embedding array<double>, vector string, error int, spread string")
    assert codes.with_label_errors(codes.compressed(frame)[0]).count() == 1


def test_walk_equals_all_distances_and_assigns_whole_nodes():
    draw = np.random.default_rng(1)
    centres = draw.integers(-1000, 1000, (40, 4))
    points = centres[draw.integers(0, 40, 5000)] + draw.integers(-20, 21, (5000, 4))
    parts, book = codes.Tree.over(points, codes.depth_for(5000, 16)), centres[:33]
    got = codes.dual_tree(parts, codes.entry_trees(book[None])[0])
    near = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (got.entry == near[parts.order]).all()
    assert (got.counts == np.bincount(near, minlength=33)).all()
    assert all((got.sums[e] == points[near == e].sum(0)).all() for e in range(33))
    assert got.in_whole_nodes > 2000
