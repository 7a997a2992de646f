"""Nearest neighbours against brute force, and archives with forged records."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from attest.llm import catalog, neighbours, warc

SF = "/root/testdata/sf0.001"


def nearest(vectors, queries, k):
    out = {}
    for q in queries:
        scores = []
        for i, v in vectors:
            if i != q[0] and len(v) == len(q[1]):
                a, b = np.array(v, float), np.array(q[1], float)
                scores.append((-(a @ b) / math.sqrt(a @ a) / math.sqrt(b @ b), i))
        out[q[0]] = sorted(scores)[:k]
    return out


def test_recall_on_whole_embeddings(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = nearest(vectors, [v for v in vectors if v[0] % 50 == 0], 5)
    got = {}
    for r in catalog.QUERIES["op2_one_bit_codes"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {i for i, _, _ in got[q]}) for q in want)
    assert hits >= 0.98 * 5 * len(want)
    exact = {q: dict((i, -s) for s, i in nearest(vectors, [v for v in vectors if v[0] == q], len(vectors))[q]) for q in want}
    for q, rows in got.items():
        assert [r for _, _, r in rows] == [1, 2, 3, 4, 5]
        assert all(abs(exact[q][i] - s) < 1e-12 for i, s, _ in rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, -1.0]), (8, []),
            (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0]), (10, [float("inf"), 1.0]), (11, [-1e-30, 0.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    indexed = neighbours.index(table)
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in neighbours.search(indexed, indexed.filter("vec_id in (0, 9)"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 7, 0.0), (0, 4, 11, -1.0)]
    assert neighbours.search(neighbours.index(table.limit(0)), neighbours.index(table.limit(0)), 5).collect() == []


def test_many_equal_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300, 400)]
    indexed = neighbours.index(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7))
    got = neighbours.search(indexed, indexed.filter("vec_id in (0, 250)"), 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, i) for i in range(1, 6)] + [(250, i) for i in range(5)]


def test_chains_of_a_block_lead_to_its_end_or_break_off():
    # 0 -> 40 -> 70 -> 130; 10 -> 20, where no find is; 50 -> 200; 90 -> 100, the block's end.
    assert warc.exits([0, 10, 40, 50, 70, 90], [40, 20, 70, 200, 130, 100], 100) == [130, None, 130, 200, 130, 100]
    assert warc.exits([], [], 100) == []


def test_a_file_has_one_entry_per_block_on_its_chain(spark, tmp_path):
    """The chain enters each block at the first record that begins in it; finds inside payloads are no entries."""
    forged = warc.record(9, "u", b"y" * 30, "0" * 64, None)
    records = [warc.record(i, "u", forged * (i % 4) + b"z" * (37 * i % 211), "0" * 64, None) for i in range(60)]
    (tmp_path / "one.warc").write_bytes(b"".join(records))
    places = [sum(map(len, records[:i])) for i in range(61)]
    files = spark.createDataFrame([("one.warc", places[-1])], "file string, file_bytes long")
    for block in (300, 1024, 1 << 20):
        found = warc.candidates(files, tmp_path.as_uri(), block)
        got = {r.block: r.entry for r in warc.reachable(found, block).collect()}
        want = {}
        for at in places[:-1]:
            want.setdefault(at // block, at)
        assert got == want


def test_forged_records_and_small_blocks(spark):
    forged = warc.record(99, "http://forged", b"y" * 40, "0" * 64, None).decode()
    half = "WARC/1.1\r\nContent-Length: 3\r\n"
    pages = [(1, "http://a", "x" * 150), (2, "http://b", "x" * 150), (3, None, forged + "tail"), (4, "a\r\nWARC/1.1\r\nContent-Length: 1", half), (5, "u", None), (6, "u", ""),
             (7, "u", half * 9 + "\r\n\r\n" + forged * 5), (8, "é", "é" * 60), (9, "é", "é" * 60), (10, "z", "short"), (11, "z", "short"), (None, "z", "n" * 200)]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, refers_to string").repartition(3)
    for limit, block in ((1, 64), (700, 100), (1 << 20, 97), (1 << 20, 1 << 20)):
        got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(table, limit, block).collect()}
        assert got == {i: (len((h or "").encode()), "revisit" if i in (2, 9) else "response", {2: 1, 9: 8}.get(i)) for i, _, h in pages}
    assert warc.round_trip(table.limit(0)).collect() == []
    assert warc.payloads(table).filter(F.col("page_id") == 3).first().digest == __import__("hashlib").sha256(pages[2][2].encode()).hexdigest()
