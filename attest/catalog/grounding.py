"""Grounding and reward (GRD, VEC-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import grounding as gr
from . import shared as sh
from .registry import query
from .shared import VIEWS, r6

NLI = {
    "v_pair": """SELECT *, entailment - contradiction AS score FROM v_nli_scores""",
    "v_sent": """SELECT case_id, rnk, sentence_idx, arg_max(score, {'a': abs(score), 'b': -premise_idx}) AS score
        FROM v_pair GROUP BY 1, 2, 3""",
    "v_ground": """SELECT case_id, rnk, arg_max(score, {'a': abs(score), 'b': -sentence_idx}) AS g_max, avg(score) AS g_avg,
        count(*) AS n_sentences FROM v_sent GROUP BY 1, 2""",
    **VIEWS,
}


@query("grd_01", """SELECT case_id, rnk, sentence_idx, premise_idx, round(score, 6) + 0.0 AS score FROM v_pair""", NLI)
def grd_01(spark, sf):
    return fx.nli_scores(spark, sf).select("case_id", "rnk", "sentence_idx", "premise_idx", r6(gr.pair_score(), "score"))


@query("vec_08", "SELECT case_id, rnk, sentence_idx, round(score, 6) + 0.0 AS score FROM v_sent", NLI)
def vec_08(spark, sf):
    return gr.sentence_scores(fx.nli_scores(spark, sf)).select("case_id", "rnk", "sentence_idx", r6("score"))


@query("grd_02", """SELECT case_id, rnk, round(g_max, 6) + 0.0 AS g_max, round(g_avg, 6) + 0.0 AS g_avg, n_sentences
    FROM v_ground""", NLI)
def grd_02(spark, sf):
    return gr.sentence_level(fx.nli_scores(spark, sf)).select("case_id", "rnk", r6("g_max"), r6("g_avg"), "n_sentences")


@query("grd_03", """SELECT case_id, rnk, round(arg_max(score, {'a': abs(score), 'b': -(sentence_idx * 4294967296 + premise_idx)}), 6)
    + 0.0 AS g_max, round(avg(score), 6) + 0.0 AS g_avg FROM v_pair GROUP BY 1, 2""", NLI)
def grd_03(spark, sf):
    return gr.whole_level(fx.nli_scores(spark, sf)).select("case_id", "rnk", r6("g_max"), r6("g_avg"))


@query("grd_04", """SELECT p.case_id, p.rnk, round(coalesce(s.g_max, 0.0::DOUBLE), 6) + 0.0 AS g_max,
    round(coalesce(s.g_avg, 0.0::DOUBLE), 6) + 0.0 AS g_avg FROM v_judged p
    LEFT JOIN v_ground s ON p.case_id = s.case_id AND p.rnk = s.rnk AND p.matched""", NLI)
def grd_04(spark, sf):
    judged = sh.judged(spark, sf)
    # Only matched predictions were scored here; the others have no pairs.
    scored = fx.nli_scores(spark, sf).join(judged.filter("matched").select("case_id", "rnk"), ["case_id", "rnk"], "left_semi")
    return gr.attach(judged, gr.sentence_level(scored)).select("case_id", "rnk", r6("g_max"), r6("g_avg"))


@query("grd_06", "SELECT case_id, rnk, label, precision FROM v_rewards", VIEWS)
def grd_06(spark, sf):
    out = gr.precision_reward(sh.judged(spark, sf), sh.case_gold_counts(spark, sf))
    return out.select("case_id", "rnk", "label", "precision")


@query("grd_07", "SELECT case_id, rnk, round(combined, 6) + 0.0 AS combined FROM v_rewards", VIEWS)
def grd_07(spark, sf):
    out = gr.precision_reward(sh.judged(spark, sf), sh.case_gold_counts(spark, sf))
    return out.select("case_id", "rnk", r6(gr.combined(F.col("g_max"), F.col("precision")), "combined"))


@query("grd_10", """SELECT case_id, rnk, label, CASE WHEN matched THEN label ELSE '' END AS matched_labels,
    round(r.g_max, 6) + 0.0 AS g_max, round(r.g_avg, 6) + 0.0 AS g_avg, precision,
    round(0.5::DOUBLE * r.g_max + 0.5::DOUBLE * precision, 6) + 0.0 AS combined
    FROM v_rewards w JOIN v_ground r USING (case_id, rnk)""", NLI)
def grd_10(spark, sf):
    rows = gr.reward_rows(gr.sentence_level(fx.nli_scores(spark, sf)), sh.judged(spark, sf))
    return rows.select("case_id", "rnk", "label", "matched_labels", r6("g_max"), r6("g_avg"), "precision", r6("combined"))


@query("grd_11", """SELECT cond, count(*) AS n, round(avg(precision), 6) + 0.0 AS accuracy,
    round(avg(r.g_max), 6) + 0.0 AS g_max, round(avg(r.g_avg), 6) + 0.0 AS g_avg
    FROM v_rewards w JOIN v_ground r USING (case_id, rnk) JOIN v_cases USING (case_id) GROUP BY 1""", NLI)
def grd_11(spark, sf):
    """Accuracy and grounding scored apart, each over all predictions and kept as a table, then merged."""
    from ..session import materialised
    accuracy = materialised(sh.judged(spark, sf).select("case_id", "rnk", "label", "matched"), "accuracy-phase")
    grounding = materialised(gr.sentence_level(fx.nli_scores(spark, sf)), "grounding-phase")
    rows = gr.reward_rows(grounding, accuracy).join(fx.cases(spark, sf), "case_id")
    return rows.groupBy("cond").agg(F.count("*").alias("n"), r6(F.avg("precision"), "accuracy"),
                                    r6(F.avg("g_max"), "g_max"), r6(F.avg("g_avg"), "g_avg"))
