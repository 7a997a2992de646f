"""Training sets (TRN) from the scored predictions, under the rules of ``operators/training.py``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import prompts as pm, training as tr
from . import shared as sh
from .registry import query
from .shared import VIEWS, r6

ASKED = "'List the 5 most likely diagnoses as JSON with name and reasoning.' || chr(10) || chr(10) || 'Patient:' || chr(10) || 'No. ' || {} || chr(10) || chr(10) || 'IMPORTANT: answer with JSON only.'"

TRAIN = {
    **VIEWS,
    "v_by_model": "SELECT subject_id, model AS item, round(avg(g_max) + 1.3e-10::DOUBLE, 6) + 0.0 AS score FROM v_judged_run GROUP BY 1, 2",
    "v_by_cond": "SELECT subject_id, cond AS item, round(avg(g_max) + 1.3e-10::DOUBLE, 6) + 0.0 AS score FROM v_judged_run GROUP BY 1, 2",
    # What was asked and said: one prompt per subject or case, one response per model of a subject or sample of a case.
    "v_subject_prompt": f"SELECT DISTINCT subject_id, {ASKED.format('subject_id')} AS prompt FROM v_cases",
    "v_subject_said": "SELECT subject_id, model AS item, string_agg(label, '; ' ORDER BY case_id, rnk) AS response FROM v_judged_run GROUP BY 1, 2",
    "v_case_prompt": f"SELECT case_id, {ASKED.format('case_id')} AS prompt FROM v_cases",
    "v_case_said": "SELECT case_id, rnk AS item, label || ', as seen in finding ' || rnk AS response FROM v_predictions",
}


def prompts(spark, sf, key):
    return fx.cases(spark, sf).select(key).distinct().withColumn("prompt", pm.ranked_prompt(F.concat(F.lit("No. "), F.col(key))))


def subject_responses(spark, sf):
    rows = sh.judged_with_run(spark, sf).groupBy("subject_id", F.col("model").alias("item"))
    said = rows.agg(F.array_sort(F.collect_list(F.struct("case_id", "rnk", "label"))).alias("said"))
    return said.select("subject_id", "item", F.array_join(F.transform("said", lambda x: x["label"]), "; ").alias("response"))


def case_responses(spark, sf):
    return fx.predictions(spark, sf).join(fx.cases(spark, sf).select("case_id", "model"), "case_id").select(
        "model", "case_id", F.col("rnk").alias("item"), F.concat("label", F.lit(", as seen in finding "), "rnk").alias("response"))


def by(spark, sf, item):
    rows = sh.judged_with_run(spark, sf).groupBy("subject_id", F.col(item).alias("item"))
    return rows.agg(r6(F.avg("g_max"), "score"))


def samples(spark, sf):
    return fx.predictions(spark, sf).join(fx.cases(spark, sf).select("case_id", "model"), "case_id").select(
        "model", "case_id", F.col("rnk").alias("item"), F.col("g_max").alias("score"))


@query("trn_01", """SELECT t.subject_id, prompt, c.response AS chosen, r.response AS rejected, round(best.score - worst.score, 6) + 0.0 AS margin FROM (
    SELECT subject_id, max({'score': score, 'item': item}) AS best, min({'score': score, 'item': item}) AS worst FROM v_by_model GROUP BY 1) t
    JOIN v_subject_prompt p ON p.subject_id = t.subject_id JOIN v_subject_said c ON c.subject_id = t.subject_id AND c.item = best.item
    JOIN v_subject_said r ON r.subject_id = t.subject_id AND r.item = worst.item WHERE round(best.score - worst.score, 9) >= 0.1::DOUBLE""", TRAIN)
def trn_01(spark, sf):
    """Across models: what the best and the worst model of each subject said."""
    pairs = tr.preference_pairs(by(spark, sf, "model"), ["subject_id"])
    return tr.with_texts(pairs, prompts(spark, sf, "subject_id"), subject_responses(spark, sf), ["subject_id"], ["subject_id"], ("chosen", "rejected")).select(
        "subject_id", *tr.PREFERENCE, r6("margin"))


@query("trn_02", """SELECT model, t.case_id, prompt, c.response AS chosen, r.response AS rejected, round(best.score - worst.score, 6) + 0.0 AS margin FROM (
    SELECT model, case_id, max({'score': g_max, 'item': rnk}) AS best, min({'score': g_max, 'item': rnk}) AS worst FROM v_judged_run GROUP BY 1, 2) t
    JOIN v_case_prompt p ON p.case_id = t.case_id JOIN v_case_said c ON c.case_id = t.case_id AND c.item = best.item
    JOIN v_case_said r ON r.case_id = t.case_id AND r.item = worst.item WHERE round(best.score - worst.score, 9) >= 0.1::DOUBLE""", TRAIN)
def trn_02(spark, sf):
    """Within a model: the best and the worst sample of each case, as texts."""
    pairs = tr.preference_pairs(samples(spark, sf), ["model", "case_id"])
    return tr.with_texts(pairs, prompts(spark, sf, "case_id"), case_responses(spark, sf), ["model", "case_id"], ["case_id"], ("chosen", "rejected")).select(
        "model", "case_id", *tr.PREFERENCE, r6("margin"))


@query("trn_03", """SELECT a.subject_id, a.item AS chosen, b.item AS rejected, round(a.score - b.score, 6) + 0.0 AS margin
    FROM v_by_cond a JOIN v_by_cond b ON a.subject_id = b.subject_id WHERE round(a.score - b.score, 9) > 0.1::DOUBLE""", TRAIN)
def trn_03(spark, sf):
    """Across runs: every two conditions of a subject that are far enough apart."""
    return tr.run_pairs(by(spark, sf, "cond"), ["subject_id"]).select("subject_id", "chosen", "rejected", r6("margin"))


@query("trn_04", """SELECT case_id, rnk, round(CASE WHEN s > 1e-12 THEN (g_max - m) / s ELSE 0.0::DOUBLE END, 6) + 0.0 AS advantage FROM (
    SELECT *, avg(g_max) OVER (PARTITION BY case_id) AS m, stddev_pop(g_max) OVER (PARTITION BY case_id) AS s FROM v_predictions)""", TRAIN)
def trn_04(spark, sf):
    """Group-relative: the score of a sample within its case."""
    return tr.group_advantages(samples(spark, sf), ["case_id"]).select("case_id", F.col("item").alias("rnk"), r6("advantage"))


@query("trn_05", """SELECT t.case_id, rnk, prompt, response, round(g_max, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY g_max DESC, rnk) AS i
    FROM v_predictions WHERE g_max >= 0.7::DOUBLE) t JOIN v_case_prompt p ON p.case_id = t.case_id JOIN v_case_said s ON s.case_id = t.case_id AND s.item = rnk WHERE i = 1""", TRAIN)
def trn_05(spark, sf):
    """Supervised: the best output of a case as prompt and response, if its reward is high."""
    best = tr.supervised_rows(samples(spark, sf), ["case_id"]).withColumn("rnk", F.col("item"))
    return tr.with_texts(best, prompts(spark, sf, "case_id"), case_responses(spark, sf).drop("model"), ["case_id"], ["case_id"], ("item",)).select(
        "case_id", "rnk", *tr.SUPERVISED, r6("score"))
