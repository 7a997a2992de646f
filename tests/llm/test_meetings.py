"""What meets in the lists of full sets: nothing inside the largest component of a list."""

from attest.llm import neardup
from tests.llm.test_dedup import brute_components, near_copies

POSTING = "class_id long, comp long, n int, place int, t long"


def test_members_of_the_largest_component_do_not_meet(spark):
    giant, stray = [(i, 0, 100, 3, 7) for i in range(300)], [(1000, 1000, 100, 3, 7)]
    alone = [(i, 0, 100, 4, 8) for i in range(300)]
    met = neardup.meetings(spark.createDataFrame(giant + stray + alone, POSTING)).select("class_ida", "class_idb").collect()
    assert len(met) == 301
    assert {r.class_ida for r in met} == {1000} and {r.class_idb for r in met} == {*range(300), 1000}


def test_every_pair_of_components_meets(spark):
    comps = {i: i % 4 if i < 40 else i for i in range(50)}
    rows = [(i, c, 100, 3, t) for i, c in comps.items() for t in (1, 2) if t == 1 or i % 2]
    met = {(min(r.class_ida, r.class_idb), max(r.class_ida, r.class_idb)) for r in
           neardup.meetings(spark.createDataFrame(rows, POSTING)).filter("compa <> compb").collect()}
    assert met == {(i, j) for i in comps for j in comps if i < j and comps[i] != comps[j]}


def test_links_across_components_are_found(spark):
    """With lists of two the star's links alone don't join all that is linked; the lists of full sets do."""
    for seed in (5, 6):
        texts = near_copies(seed)
        comps, _ = brute_components(texts)
        got = neardup.deduped(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), short=1).collect()
        assert {r.doc_id: r.component_id for r in got} == comps
