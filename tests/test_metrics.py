"""Ranking metrics, label tables, grounding and taxonomy on small frames."""

import pytest
from pyspark.sql import functions as F

from attest.operators import cohorts as co, grounding as gr, judging as jd, ranking as rk


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_f1(spark):
    rows = frame(spark, [(0.8, 0.5), (0.7, 0.7), (0.6, 0.8), (0.0, 0.0)], "p double, r double")
    got = [round(x[0], 3) for x in rows.select(rk.f1(F.col("p"), F.col("r"))).collect()]
    assert got == [0.615, 0.7, 0.686, 0.0]


def test_reward_at_k(spark):
    scores = frame(spark, [(1, i + 1, v) for i, v in enumerate([0.8, 0.6, 0.4, 0.2, 0.1])] + [(2, 1, 0.5)],
                   "case_id int, rnk int, reward double")
    cases = frame(spark, [(1,), (2,), (3,)], "case_id int")
    got = {(r.case_id, r.k): round(r.value, 6) for r in rk.reward_at_k(scores, cases, max_k=3).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [0.8, 0.7, 0.6]
    assert [got[2, k] for k in (1, 2, 3)] == [0.5, 0.5, 0.5]  # k beyond the list
    assert [got[3, k] for k in (1, 2, 3)] == [0.0, 0.0, 0.0]  # no predictions
    with pytest.raises(ValueError):
        rk.reward_at_k(scores, cases, max_k=0)


def test_three_recalls_differ_on_repeated_labels(spark):
    preds = frame(spark, [(1, 1, "a"), (1, 2, "A"), (1, 3, "a"), (1, 4, "x"), (2, 1, "a")], "case_id int, rnk int, label string")
    gold = frame(spark, [(1, "a"), (1, "b")], "case_id int, label string")
    cases = frame(spark, [(1,), (2,), (3,)], "case_id int")
    tally = rk.tally_at_k(rk.label_verdicts(preds, gold), rk.gold_counts(cases, gold), 4)
    at3 = {name: {r.case_id: (round(r.precision, 4), r.recall) for r in rk.precision_recall(tally, name).filter("k = 3").collect()}
           for name in rk.RECALLS}
    assert at3["hits"][1] == (1.0, 1.5)
    assert at3["capped"][1] == (1.0, 1.0)
    assert at3["covered"][1] == (1.0, 0.5)
    assert at3["covered"][2] == (0.0, 0.0) and at3["covered"][3] == (0.0, 0.0)


def test_label_and_match_tallies_agree(spark):
    preds = frame(spark, [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "x")], "case_id int, rnk int, label string")
    gold = frame(spark, [(1, "a"), (1, "b"), (2, "y")], "case_id int, label string")
    judged = rk.label_verdicts(preds, gold)
    counts = rk.gold_counts(preds.select("case_id").distinct(), gold)
    matches = judged.filter("matched").select("case_id", "rnk", F.col("label").alias("gold_label"))
    def key(df):
        return sorted(tuple(r) for r in df.select("case_id", "k", "n_gold", "n_pred", "hits", "covered").collect())
    assert key(rk.tally_at_k(judged, counts, 3)) == key(rk.tally_at_k(judged, counts, 3, matches))


def test_recall_never_falls_with_k(spark):
    preds = frame(spark, [(c, r, f"l{(c * r) % 4}") for c in range(20) for r in range(1, 6)], "case_id int, rnk int, label string")
    gold = frame(spark, [(c, f"l{c % 4}") for c in range(20)] + [(c, "l1") for c in range(0, 20, 3)], "case_id int, label string").distinct()
    cases = frame(spark, [(c,) for c in range(20)], "case_id int")
    tally = rk.tally_at_k(rk.label_verdicts(preds, gold), rk.gold_counts(cases, gold), 5)
    rows = rk.precision_recall(tally).orderBy("case_id", "k").collect()
    for a, b in zip(rows, rows[1:]):
        assert a.case_id != b.case_id or b.recall >= a.recall


def test_macro_micro(spark):
    preds = frame(spark, [(1, "HF"), (1, "HTN"), (2, "HF"), (2, "DM"), (3, "HTN")], "case_id int, label string")
    gold = frame(spark, [(1, "HF"), (1, "DM"), (2, "DM"), (3, "HF"), (3, "HTN")], "case_id int, label string")
    cases = frame(spark, [(1,), (2,), (3,)], "case_id int")
    counts = rk.label_counts(preds, gold, cases)
    got = {r.label: (r.tp, r.fp, r.fn, r.tn, round(r.f1, 3)) for r in counts.collect()}
    assert got == {"HF": (1, 1, 1, 0, 0.5), "DM": (1, 0, 1, 1, 0.667), "HTN": (1, 1, 0, 1, 0.667)}
    total = rk.macro_micro(counts).first()
    assert (round(total.macro_f1, 4), round(total.micro_f1, 4), total.tp, total.fp, total.fn) == (0.6111, 0.6, 3, 2, 2)


def test_retrieval_metrics(spark):
    hits = frame(spark, [(1, 1, "d1"), (1, 2, "d2"), (1, 3, "d3"), (2, 1, "d4"), (2, 2, "d5"), (2, 3, "d6"), (3, 1, "d7"), (3, 2, "d8")],
                 "query_id int, rnk int, doc_id string")
    rel = frame(spark, [(1, "d1"), (2, "d5"), (3, "zz")], "query_id int, doc_id string")
    asked = frame(spark, [(1,), (2,), (3,)], "query_id int")
    got = {r.k: round(r.success, 4) for r in rk.retrieval_metrics(hits, rel, asked, 3).collect()}
    assert got == {1: 0.3333, 2: 0.6667, 3: 0.6667}
    assert round(rk.mean_reciprocal_rank(hits, rel, asked).first().mrr, 4) == 0.5


def test_ndcg(spark):
    rows = frame(spark, [(1, 1, 0.2), (1, 2, 0.8), (2, 1, 0.0), (2, 2, -0.5)], "case_id int, rnk int, v double")
    got = {(r.case_id, r.k): round(r.ndcg, 6) for r in rk.ndcg_at_k(rows, "v", 2).collect()}
    import math
    expected = (0.2 + 0.8 / math.log2(3)) / (0.8 + 0.2 / math.log2(3))
    assert got[1, 1] == 1.0 and got[1, 2] == round(expected, 6)
    assert got[2, 1] == 0.0 and got[2, 2] == 0.0


def nli(spark, rows):
    return frame(spark, rows, "case_id int, rnk int, sentence_idx int, premise_idx int, entailment double, contradiction double")


def test_signed_maximum_takes_the_first_on_ties(spark):
    rows = nli(spark, [(1, 1, 0, 0, 0.5, 0.0), (1, 1, 0, 1, 0.0, 0.5), (1, 1, 1, 0, None, 0.5), (1, 1, 1, 1, 0.5, None)])
    got = {r.sentence_idx: r.score for r in gr.sentence_scores(rows).collect()}
    assert got == {0: 0.5, 1: -0.5}
    whole = gr.sentence_level(rows).first()
    assert (whole.g_max, whole.g_avg, whole.n_sentences) == (0.5, 0.0, 2)


def test_zero_rules(spark):
    preds = frame(spark, [(1, 1, "a"), (1, 2, "b")], "case_id int, rnk int, label string")
    scored = gr.sentence_level(nli(spark, [(1, 1, 0, 0, 0.9, 0.1)]))
    got = {r.rnk: r.g_max for r in gr.attach(preds, scored).collect()}
    assert got == {1: 0.8, 2: 0.0}
    assert {r.rnk: r.g_max for r in gr.attach(preds, scored, None).collect()} == {1: 0.8, 2: None}


def test_reward_weight_is_checked():
    with pytest.raises(ValueError):
        gr.combined(None, None, 1.5)


def test_phases_must_cover_the_same_predictions(spark):
    grounded = frame(spark, [(1, 1, 0.5, 0.5)], "case_id int, rnk int, g_max double, g_avg double")
    judged = frame(spark, [(1, 2, "a", True)], "case_id int, rnk int, label string, matched boolean")
    with pytest.raises(Exception, match="one phase only"):
        gr.reward_rows(grounded, judged).collect()


def test_taxonomy_bounds_and_rates(spark):
    rows = frame(spark, [(1, 1, 0.5, True), (1, 2, 0.51, True), (1, 3, -0.6, False), (2, 1, None, None), (2, 2, -0.9, True), (2, 3, 0.9, False)],
                 "case_id int, rnk int, g_max double, matched boolean")
    got = {r.outcome: r.n for r in co.taxonomy_long(rows, 3).collect()}
    assert got == {"Evidence-Based": 1, "Reasoning Failure": 1, "Weakly Supported": 1, "Unsupported Error": 1, "Lucky Guess": 1, "Hallucination": 1}
    assert abs(sum(r.rate for r in co.taxonomy_long(rows, 3).collect()) - 1) < 1e-12
    with pytest.raises(ValueError):
        co.taxonomy(rows, 3, "missing")


def test_bins_use_the_exact_edges(spark):
    rows = frame(spark, [(0.3,), (0.6,), (0.7,), (0.9,), (1.0,), (1.2,)], "c double")
    assert [r[0] for r in rows.select(jd.bin_index(F.col("c"))).collect()] == [2, 5, 6, 9, 9, None]


def test_out_of_range_confidence_stays_in_the_denominator(spark):
    rows = frame(spark, [(0.5, True), (1.5, True)], "confidence double, gold boolean")
    got = jd.calibration(rows).first()
    assert (round(got.ece, 6), got.out_of_range) == (0.25, 1)


def test_agreement_of_identical_raters(spark):
    rows = frame(spark, [(True, True)] * 3, "a boolean, b boolean")
    assert jd.agreement(rows, "a", "b").first().kappa == 1.0


def test_coverage_curve_keeps_every_rank(spark):
    rows = [(1, r, f"l{r % 4}", r % 4 < 2) for r in range(1, 14)]
    judged = spark.createDataFrame(rows, "case_id int, rnk int, label string, matched boolean")
    for width in (2, 5, 64):
        got = [(r.rnk, r.hits, r.covered) for r in rk.coverage_curve(judged, width).orderBy("rnk").collect()]
        hits, seen, want = 0, set(), []
        for _, rank, label, matched in rows:
            hits += matched
            seen |= {label} if matched else set()
            want.append((rank, hits, len(seen)))
        assert got == want


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_quantiles_are_exact_in_any_buckets(spark, bucket_rows):
    import numpy as np

    from attest.operators import stats as st
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("a", 101), ("b", 40), (None, 7)) for v in np.round(rng.normal(size=n), 1)] + [("a", None)]
    table = spark.createDataFrame(rows, "g string, v double")
    groups = table.groupBy("g").count()
    got = {r.g: (r.low, r.mid) for r in st.with_quantiles(groups, table, F.col("v"), {"low": 0.25, "mid": 0.5}, ("g",), bucket_rows).collect()}
    for g in ("a", "b", None):
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx((np.quantile(values, 0.25), np.quantile(values, 0.5)))
    whole = st.with_quantiles(table.select(F.count("*").alias("n")), table, F.col("v"), {"mid": 0.5}, (), bucket_rows).first()
    assert whole.mid == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5))


def test_training_rules(spark):
    from attest.operators import training as tr
    rows = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.2), (1, "z", 0.9), (2, "x", 0.5), (2, "y", 0.45), (3, "x", None), (4, "x", 0.8)], "c int, item string, score double")
    assert [tuple(r) for r in tr.preference_pairs(rows, ["c"]).collect()] == [(1, "z", "y", 0.7)]
    assert {tuple(r)[:3] for r in tr.run_pairs(rows, ["c"]).collect()} == {(1, "x", "y"), (1, "z", "y")}
    assert {(r.c, r["item"]): round(r.advantage, 6) for r in tr.group_advantages(rows, ["c"]).collect()}[(4, "x")] == 0.0
    assert {tuple(r) for r in tr.supervised_rows(rows, ["c"]).collect()} == {(1, "x", 0.9), (4, "x", 0.8)}
