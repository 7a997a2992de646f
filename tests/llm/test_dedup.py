"""Near-duplicates and repeated passages against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.llm import anchors, catalog, doubling, neardup, suffixes
from attest.llm.components import components

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[j:j + 5]) for j in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_components(texts, percent=85):
    """{doc_id: component} of {doc_id: text}."""
    sets, parent = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    seen = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in seen[s])
        for s in sets[i]:
            seen[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def brute_removal(texts):
    """{doc_id: (n_bytes, n_removed, n_spans, digest, kept)} of {doc_id: text}."""
    data, first = {i: (t or "").encode() for i, t in texts.items()}, {}
    for i in sorted(data):
        for s in range(len(data[i]) - 49):
            first.setdefault(data[i][s:s + 50], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < i:
                gone[s:s + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    return out


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_queries_on_whole_documents(spark):
    texts = texts_of(spark, SF)
    comps, sizes = brute_components(texts)
    got = catalog.QUERIES["op4_neardup"](spark, SF).collect()
    assert len(got) == len(texts)
    assert all((r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], comps[r.doc_id], comps[r.doc_id] == r.doc_id) for r in got)
    want = brute_removal(texts)
    got = catalog.QUERIES["op7_suffix_dedup"](spark, SF).collect()
    assert len(got) == len(texts)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4] for r in got)


def near_copies(seed, n=120, length=170):
    """One text, copies with a few words changed, and texts that share a long passage with it but are not near."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(length)]
    texts = {}
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(length)] = word()
        texts[rng.randrange(10**6)] = " ".join(w)
    for _ in range(n // 2):
        texts[rng.randrange(10**6)] = " ".join(base[40:90] + [word() for _ in range(100)])
    return texts


@pytest.mark.parametrize("short", [2, 10, 64])
def test_long_lists_lose_no_link(spark, short):
    texts = near_copies(short)
    comps, _ = brute_components(texts)
    got = neardup.deduped(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), short=short).collect()
    assert {r.doc_id: r.component_id for r in got} == comps


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None, 7), (2, "", 7), (3, " \t", 7), (5, "One two", 7), (4, "one  TWO", 7), (6, long, 7), (6, long, 7), (7, long + " x", 7), (None, long, 7), (8, "other text", 7), (8, "one two", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.deduped(docs).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 36, 6, True), (7, 37, 6, False),
                   (None, 36, None, True), (8, 1, 4, False)}
    kept = neardup.kept(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert neardup.deduped(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 300)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)] + [(5, 5), (None, 3), (7, None)] + [(1000, i) for i in range(1001, 1300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in parent)


def test_windows_of_any_slice(monkeypatch):
    """Equal windows have equal anchors at equal places, whatever the slices."""
    data = np.random.default_rng(0).integers(97, 101, 4000, dtype=np.uint8)
    data[3000:3400] = data[200:600]
    ends, skipped = np.array([1500, 1500, 2900, 4000]), np.zeros(4, bool)
    seen = {}
    for size in (64, 1000, 1 << 16):
        monkeypatch.setattr(anchors, "SLICE", size)
        windows = {}
        for at, rank, first, last, anchor in anchors.anchored(data, ends, skipped):
            for f, l, a in zip(first, last, anchor):
                windows |= {at + s: (a - s, rank[a]) for s in range(f, l + 1)}
        assert set(windows) == {s for b, e in ((0, 1500), (1500, 2900), (2900, 4000)) for s in range(b, e - 49)}
        assert all(seen.setdefault(data[s:s + 50].tobytes(), w) == w for s, w in windows.items())


@pytest.mark.parametrize("chunk_bytes", [300, 4000, 8 << 20])
def test_removal_in_chunks(spark, chunk_bytes):
    rng = random.Random(chunk_bytes)
    line = lambda n: "".join(rng.choices("ab é", k=n))
    passages = [line(rng.randrange(45, 160)) for _ in range(6)]
    texts = {i: "".join(rng.choice([line(rng.randrange(0, 60)), rng.choice(passages)]) for _ in range(rng.randrange(0, 9))) for i in rng.sample(range(-500, 500), 60)}
    texts |= {900: "a" * 400, 901: "a" * 70 + "b", 902: "", 903: None, 904: texts[next(iter(texts))], 905: "a" * 49}
    want = brute_removal(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, passages[0] * 2, "x"), (901, "a" * 70 + "b", "x")], "doc_id long, text string, n_spans string")
    got = suffixes.removed(docs, with_text=True, chunk_bytes=chunk_bytes).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert (r.n_removed, r.text) == (0, passages[0] * 2)
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4], r.doc_id
            assert r.text == (None if texts[r.doc_id] is None else want[r.doc_id][4].decode("utf-8", "ignore"))


def test_removal_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert suffixes.cleaned(docs).collect() == [] and suffixes.cleaned(docs).columns == docs.columns
    one = spark.createDataFrame([(1, "x" * 200, None)], "doc_id long, text string, source string")
    assert suffixes.cleaned(one).first().text == "x" * 200
    assert one.select(F.length("text")).first()[0] == 200


def test_doubling_over_every_position_gives_the_same_rows(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randint(30, 90))) for _ in range(6)]
    texts = [(i, "".join(rng.choice(passages)[rng.randint(0, 9):] for _ in range(rng.randint(0, 4)))) for i in range(40)]
    rows = [*texts, (3, passages[0] * 2), (None, passages[1] * 2), (50, None), (51, ""), (52, "ab" * 60), (53, "b" + "ab" * 60)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(3)
    columns = ["doc_id", "row", *doubling.RESULT]
    want = sorted(map(str, suffixes.removed(docs).select(*columns).collect()))
    assert sorted(map(str, doubling.removed(docs).select(*columns).collect())) == want
    assert doubling.removed(docs.limit(0)).collect() == []
