"""Near-duplicates at a percentage the caller names; 85 where none is named."""

import collections

import pytest

from attest.llm import catalog, neardup
from tests.llm.test_dedup import SF, near_copies, shingle_set, texts_of


def brute_components_at(texts, percent):
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
    return {i: find(i) for i in texts}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_pairs_from_80_are_linked(spark):
    """Pairs at exactly 80 and at 82 in 100, and one below 80, of short and of long sets."""
    word = iter(f"w{i}" for i in range(10**6))
    fresh = lambda n: [next(word) for _ in range(n)]
    texts, pairs = {}, []
    for own, other in ((16, 4), (80, 20), (82, 18), (79, 21), (400, 100), (410, 90), (395, 105)):
        base = fresh(own + 4)
        i = len(texts)
        texts |= {i: " ".join(base), i + 1: " ".join(base + fresh(other))}
        pairs.append((i, 100 * own >= 80 * (own + other)))
    left = {r.doc_id for r in neardup.kept(frame(spark, texts), percent=80).collect()}
    assert left == {i for i, linked in pairs} | {i + 1 for i, linked in pairs if not linked}
    assert neardup.kept(frame(spark, texts)).count() == len(texts)


def test_whole_documents_at_80_and_85(spark):
    texts = texts_of(spark, SF)
    comps = brute_components_at(texts, 80)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in neardup.kept(docs, percent=80).collect()} == {i for i in texts if comps[i] == i}
    assert {r.doc_id: r.component_id for r in catalog.QUERIES["op4_neardup"](spark, SF).collect()} == brute_components_at(texts, 85)


@pytest.mark.parametrize("short", [2, 64])
def test_long_lists_lose_no_link_at_80(spark, short):
    texts = near_copies(short + 1)
    got = neardup.deduped(frame(spark, texts), short=short, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components_at(texts, 80)


def test_least_shared_values():
    assert [(neardup.exact(p), neardup.shared(p)) for p in (85, 80)] == [(27, 17), (25, 14)]
