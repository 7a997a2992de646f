"""Outcome taxonomy and cohort reports (TAX, COH, JOIN-14, SET-01, FIL-08, AGG-14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import cohorts as co
from . import shared as sh
from .registry import query
from .shared import VIEWS, r6

CONDITIONS = ["baseline", "rag", "tuned"]
OUT = """CASE WHEN g_max > 0.5::DOUBLE THEN CASE WHEN matched THEN 'Evidence-Based' ELSE 'Reasoning Failure' END
    WHEN g_max < -0.5::DOUBLE THEN CASE WHEN matched THEN 'Lucky Guess' ELSE 'Hallucination' END
    ELSE CASE WHEN matched THEN 'Weakly Supported' ELSE 'Unsupported Error' END END"""
COHORT = {
    **VIEWS,
    "v_out": f"SELECT *, {OUT} AS outcome FROM v_judged_run",
    "v_case_score": "SELECT subject_id, cond, round(avg(g_max), 12) + 0.0 AS score FROM v_judged_run GROUP BY 1, 2",
    "v_paths": """SELECT subject_id, max(CASE WHEN cond = 'baseline' THEN score END) AS baseline,
        max(CASE WHEN cond = 'rag' THEN score END) AS rag, max(CASE WHEN cond = 'tuned' THEN score END) AS tuned
        FROM v_case_score GROUP BY 1 HAVING count(*) = 3""",
}


def per_subject(spark, sf):
    return co.case_scores(sh.judged_with_run(spark, sf), "g_max", "subject_id")


def paths(spark, sf):
    return co.trajectory(per_subject(spark, sf), CONDITIONS, "subject_id")


@query("tax_01", "SELECT case_id, rnk, outcome FROM v_out", COHORT)
def tax_01(spark, sf):
    return sh.judged(spark, sf).select("case_id", "rnk", co.outcome(F.col("g_max"), F.col("matched")).alias("outcome"))


@query("tax_02", """SELECT cond, t.outcome, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / total, 6) + 0.0 AS rate FROM
    (SELECT cond, count(*) AS total FROM v_out WHERE rnk <= 3 GROUP BY 1) CROSS JOIN (SELECT unnest(['Evidence-Based',
        'Reasoning Failure', 'Weakly Supported', 'Unsupported Error', 'Lucky Guess', 'Hallucination']) AS outcome) t
    LEFT JOIN (SELECT cond, outcome, count(*) AS n FROM v_out WHERE rnk <= 3 GROUP BY 1, 2) c USING (cond, outcome)""", COHORT)
def tax_02(spark, sf):
    out = co.taxonomy_long(sh.judged_with_run(spark, sf), 3, by=("cond",))
    return out.select("cond", "outcome", "n", r6("rate"))


@query("agg_14", "SELECT subject_id, cond, round(score, 6) + 0.0 AS score FROM v_case_score", COHORT)
def agg_14(spark, sf):
    return per_subject(spark, sf).select("subject_id", "cond", r6("score"))


@query("coh_01", """SELECT subject_id, round(tuned - baseline, 6) + 0.0 AS change,
    CASE WHEN tuned - baseline > 0.15::DOUBLE THEN 'improved' WHEN tuned - baseline < -0.15::DOUBLE THEN 'worsened'
    ELSE 'stable' END AS movement FROM v_paths""", COHORT)
def coh_01(spark, sf):
    return co.movement(paths(spark, sf), "baseline", "tuned").select("subject_id", r6("change"), "movement")


@query("coh_02", """SELECT count(CASE WHEN NOT baseline > 0 AND tuned > 0 THEN 1 END) AS neg_to_pos,
    count(CASE WHEN NOT baseline > 0 AND NOT tuned > 0 THEN 1 END) AS neg_to_neg,
    count(CASE WHEN baseline > 0 AND tuned > 0 THEN 1 END) AS pos_to_pos,
    count(CASE WHEN baseline > 0 AND NOT tuned > 0 THEN 1 END) AS pos_to_neg,
    round(avg((tuned > 0)::INT), 6) + 0.0 AS positive_after FROM v_paths""", COHORT)
def coh_02(spark, sf):
    out = co.sign_transitions(paths(spark, sf), "baseline", "tuned")
    return out.select("neg_to_pos", "neg_to_neg", "pos_to_pos", "pos_to_neg", r6("positive_after"))


@query("coh_03", """SELECT count(*) AS n, round(avg(d), 6) + 0.0 AS mean, round(quantile_cont(d, 0.5), 6) + 0.0 AS median,
    round(stddev_pop(d), 6) + 0.0 AS std, round(100 * avg((d > 0)::INT), 6) + 0.0 AS improved,
    round(100 * avg((d > 0.1::DOUBLE)::INT), 6) + 0.0 AS improved_01, round(100 * avg((d > 0.2::DOUBLE)::INT), 6) + 0.0 AS improved_02,
    round(100 * avg((d < 0)::INT), 6) + 0.0 AS worsened, round(100 * avg((d < -0.1::DOUBLE)::INT), 6) + 0.0 AS worsened_01
    FROM (SELECT tuned - baseline AS d FROM v_paths)""", COHORT)
def coh_03(spark, sf):
    out = co.change_statistics(paths(spark, sf), "baseline", "tuned")
    return out.select("n", *[r6(c) for c in out.columns[1:]])


@query("coh_04", """SELECT cond, round(avg(score), 6) + 0.0 AS mean, count(*) AS n FROM
    (UNPIVOT v_paths ON baseline, rag, tuned INTO NAME cond VALUE score) GROUP BY 1""", COHORT)
def coh_04(spark, sf):
    return co.mean_trajectory(paths(spark, sf), CONDITIONS).select("cond", r6("mean"), "n")


@query("join_14", "SELECT subject_id FROM v_paths", COHORT)
def join_14(spark, sf):
    scored = per_subject(spark, sf)
    return scored.groupBy("subject_id").agg(F.count_distinct("cond").alias("n")).filter(
        F.col("n") == len(CONDITIONS)).select("subject_id")


@query("set_01", """SELECT subject_id FROM v_cases WHERE cond = 'baseline' INTERSECT SELECT subject_id FROM v_cases
    WHERE cond = 'rag' INTERSECT SELECT subject_id FROM v_cases WHERE cond = 'tuned'""")
def set_01(spark, sf):
    cases = fx.cases(spark, sf)
    parts = [cases.filter(F.col("cond") == c).select("subject_id") for c in CONDITIONS]
    return parts[0].intersect(parts[1]).intersect(parts[2])


@query("fil_08", """SELECT case_id, rnk, matched, g_avg FROM v_judged WHERE abs(g_avg) > 0.3::DOUBLE""", VIEWS)
def fil_08(spark, sf):
    from ..operators.filters import significant
    return significant(sh.judged(spark, sf), "g_avg", 0.3).select("case_id", "rnk", "matched", "g_avg")


@query("coh_05", """SELECT case_id, rnk, length(reasoning) AS reasoning_length, round(coalesce(p.g_avg, 0.0::DOUBLE), 6) + 0.0 AS g_avg,
    coalesce(matched, false) AS matched FROM v_reasoning r LEFT JOIN v_judged p USING (case_id, rnk)
    WHERE trim(reasoning) <> ''""", VIEWS)
def coh_05(spark, sf):
    from ..operators.filters import reasoning_rows
    rows = fx.reasoning(spark, sf).join(
        sh.judged(spark, sf).select("case_id", "rnk", "g_avg", "matched"), ["case_id", "rnk"], "left")
    out = reasoning_rows(rows.fillna(0.0, ["g_avg"]), "g_avg")
    return out.select("case_id", "rnk", "reasoning_length", r6("g_avg"), "matched")


@query("coh_06", """SELECT correct, round(reward, 6) + 0.0 AS reward, round(g_avg, 6) + 0.0 AS alignment FROM (
    SELECT matched AS correct, 0.5::DOUBLE * g_max + 0.5::DOUBLE * matched::INT AS reward, g_avg FROM v_judged)
    WHERE correct IS NOT NULL""", VIEWS)
def coh_06(spark, sf):
    rows = sh.rewards(spark, sf)
    return rows.filter(F.col("matched").isNotNull()).select(
        F.col("matched").alias("correct"), r6("combined", "reward"), r6("g_avg", "alignment"))


@query("coh_07", """SELECT model, case_id, rnk, matched, round(g_avg, 6) + 0.0 AS g_avg FROM v_judged_run
    WHERE g_avg IS NOT NULL""", VIEWS)
def coh_07(spark, sf):
    # Verdicts and rewards are aligned on (case, rank): a row missing on either side drops out.
    rewards = fx.predictions(spark, sf).select("case_id", "rnk", "g_avg").filter(F.col("g_avg").isNotNull())
    verdicts = sh.judged(spark, sf).select("case_id", "rnk", "matched")
    return rewards.join(verdicts, ["case_id", "rnk"]).join(
        fx.cases(spark, sf).select("case_id", "model"), "case_id").select("model", "case_id", "rnk", "matched", r6("g_avg"))
