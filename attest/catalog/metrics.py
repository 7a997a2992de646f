"""Ranking metrics, per-case metrics and aggregates (WIN, MET-01..06/09, AGG, TOP, SET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import casemetrics as cm, ranking as rk
from . import shared as sh
from .registry import query
from .shared import VIEWS, r6


def _pr(recall):
    def run(spark, sf):
        rows = rk.precision_recall(sh.tally(spark, sf), recall)
        return rows.select("case_id", "k", r6("precision"), r6("recall"))
    return run


def _pr_sql(top):
    return f"""SELECT case_id, k,
        round(CASE WHEN n_pred > 0 AND n_gold > 0 THEN hits::DOUBLE / n_pred ELSE 0.0::DOUBLE END, 6) + 0.0 AS precision,
        round(CASE WHEN n_pred > 0 AND n_gold > 0 THEN ({top})::DOUBLE / n_gold ELSE 0.0::DOUBLE END, 6) + 0.0 AS recall
        FROM v_tally"""


@query("win_01", """SELECT c.case_id, k, round(coalesce(avg(g_max), 0.0::DOUBLE), 6) + 0.0 AS reward
    FROM v_cases c CROSS JOIN v_ks LEFT JOIN v_predictions p ON p.case_id = c.case_id AND rnk <= k GROUP BY 1, 2""", VIEWS)
def win_01(spark, sf):
    rows = rk.reward_at_k(fx.predictions(spark, sf), fx.cases(spark, sf), "g_max")
    return rows.select("case_id", "k", r6("value", "reward"))


KIND_VIEWS = {
    "v_kpred": """SELECT case_id, CASE WHEN label < 'Brand#2' THEN 'diagnosis' ELSE 'procedure' END AS kind, label,
        row_number() OVER (PARTITION BY case_id, CASE WHEN label < 'Brand#2' THEN 'diagnosis' ELSE 'procedure' END
            ORDER BY rnk) AS rnk FROM v_predictions""",
    "v_kgold": """SELECT case_id, CASE WHEN label < 'Brand#2' THEN 'diagnosis' ELSE 'procedure' END AS kind, label
        FROM v_gold""",
}


def by_kind(df):
    """Fixture split of the labels into the two label kinds a case is scored on."""
    return df.withColumn("kind", F.when(F.col("label") < "Brand#2", "diagnosis").otherwise("procedure"))


@query("win_02", """SELECT case_id, kind, k,
        round(CASE WHEN n > 0 AND n_gold > 0 THEN hits::DOUBLE / n ELSE 0.0::DOUBLE END, 6) + 0.0 AS precision,
        round(CASE WHEN n > 0 AND n_gold > 0 THEN hits::DOUBLE / n_gold ELSE 0.0::DOUBLE END, 6) + 0.0 AS recall FROM (
    SELECT c.case_id, t.kind, k, (SELECT count(*) FROM v_kgold g WHERE g.case_id = c.case_id AND g.kind = t.kind) AS n_gold,
        count(p.rnk) AS n, count(g.label) AS hits
    FROM v_cases c CROSS JOIN v_ks CROSS JOIN (VALUES ('diagnosis'), ('procedure')) t(kind)
    LEFT JOIN v_kpred p ON p.case_id = c.case_id AND p.kind = t.kind AND p.rnk <= k
    LEFT JOIN v_kgold g ON g.case_id = c.case_id AND g.kind = t.kind AND g.label = p.label
    GROUP BY 1, 2, 3)""", {**VIEWS, **KIND_VIEWS})
def win_02(spark, sf):
    from pyspark.sql import Window as W
    order = W.partitionBy("case_id", "kind").orderBy("rnk")
    pred = by_kind(fx.predictions(spark, sf)).withColumn("rnk", F.row_number().over(order)).filter("rnk <= 5")
    gold = by_kind(fx.gold(spark, sf))
    both = fx.cases(spark, sf).select("case_id", F.explode(F.array(F.lit("diagnosis"), F.lit("procedure"))).alias("kind"))
    keys = ("case_id", "kind")
    truth = gold.select("case_id", "kind", "label", F.lit(True).alias("matched"))
    judged = pred.join(truth, ["case_id", "kind", "label"], "left").fillna(False, ["matched"])
    tally = rk.tally_at_k(judged, rk.gold_counts(both, gold, keys), 5, keys=keys)
    return rk.precision_recall(tally, "hits").select("case_id", "kind", "k", r6("precision"), r6("recall"))


query("win_03", _pr_sql("least(hits, n_gold)"), VIEWS)(_pr("capped"))
query("win_04", _pr_sql("covered"), VIEWS)(_pr("covered"))


@query("win_05", """SELECT j.case_id, j.rnk, j.label, j.matched,
        count(CASE WHEN b.matched THEN 1 END) AS hits, count(DISTINCT CASE WHEN b.matched THEN b.label END) AS covered
    FROM v_judged j JOIN v_judged b ON b.case_id = j.case_id AND b.rnk <= j.rnk GROUP BY 1, 2, 3, 4""", VIEWS)
def win_05(spark, sf):
    return rk.coverage_curve(sh.judged(spark, sf)).select("case_id", "rnk", "label", "matched", "hits", "covered")


@query("vec_07", """SELECT case_id, k, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END, 6) + 0.0
    AS f1 FROM v_pr""", VIEWS)
def vec_07(spark, sf):
    return rk.precision_recall(sh.tally(spark, sf)).select("case_id", "k", r6("f1"))


LABEL_VIEWS = {**VIEWS, "v_labels_n": """SELECT coalesce(p.label, g.label) AS label,
        count(CASE WHEN p.label IS NOT NULL AND g.label IS NOT NULL THEN 1 END) AS tp,
        count(CASE WHEN g.label IS NULL THEN 1 END) AS fp, count(CASE WHEN p.label IS NULL THEN 1 END) AS fn
    FROM (SELECT DISTINCT case_id, label FROM v_predictions) p FULL JOIN v_gold g
        ON p.case_id = g.case_id AND p.label = g.label GROUP BY 1""",
    "v_label_f": """SELECT *, (SELECT count(*) FROM v_cases) - tp - fp - fn AS tn, tp + fn AS support,
        CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS precision,
        CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS recall,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1
        FROM v_labels_n WHERE tp + fn > 0"""}


def label_table(spark, sf):
    return rk.label_counts(fx.predictions(spark, sf), fx.gold(spark, sf), fx.cases(spark, sf))


@query("met_01", """SELECT label, tp, fp, fn, tn, support, round(precision, 6) + 0.0 AS precision,
    round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1 FROM v_label_f""", LABEL_VIEWS)
def met_01(spark, sf):
    return label_table(spark, sf).select("label", "tp", "fp", "fn", "tn", "support", r6("precision"), r6("recall"), r6("f1"))


@query("met_02", """SELECT round(avg(f1), 6) + 0.0 AS macro_f1,
    round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) + 0.0 AS micro_f1,
    sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM v_label_f""", LABEL_VIEWS)
def met_02(spark, sf):
    return rk.macro_micro(label_table(spark, sf)).select(r6("macro_f1"), r6("micro_f1"), "tp", "fp", "fn")


TOPN_VIEWS = {**VIEWS, "v_top": "SELECT label FROM v_gold GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 10"}


@query("met_05", """SELECT case_id, k, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0::DOUBLE END, 6) + 0.0 AS ndcg FROM (
    SELECT case_id, k, sum(g_max / log2(rnk + 1)) AS dcg, sum(g_max / log2(best + 1)) AS idcg FROM (
        SELECT p.case_id, k, g_max, rnk, row_number() OVER (PARTITION BY p.case_id, k ORDER BY g_max DESC) AS best
        FROM v_predictions p JOIN v_ks ON rnk <= k) GROUP BY 1, 2)""", VIEWS)
def met_05(spark, sf):
    """NDCG at every k up to the list length; shorter lists keep their value for larger k."""
    rows = rk.ndcg_at_k(fx.predictions(spark, sf), "g_max")
    return rows.select("case_id", "k", r6("ndcg"))


@query("met_06", """SELECT g.label AS gold, p.label AS pred, count(*) AS n FROM v_predictions p JOIN v_gold g USING (case_id)
    WHERE g.label IN (FROM v_top) AND p.label IN (FROM v_top) GROUP BY 1, 2""", TOPN_VIEWS)
def met_06(spark, sf):
    gold = fx.gold(spark, sf)
    return rk.confusion(fx.predictions(spark, sf), gold, rk.top_labels(gold, 10))


def metric_table(spark, sf):
    return cm.metric_rows(sh.tally(spark, sf), sh.rewards(spark, sf), fx.cases(spark, sf))


@query("met_09", "SELECT case_id, metric, k, round(value, 6) + 0.0 AS value FROM v_metric_rows", VIEWS)
def met_09(spark, sf):
    return metric_table(spark, sf).select("case_id", "metric", "k", r6("value"))


@query("agg_04", """SELECT metric, k, round(avg(value), 6) + 0.0 AS value, count(*) AS n FROM v_metric_rows
    GROUP BY 1, 2""", VIEWS)
def agg_04(spark, sf):
    return cm.mean_metrics(metric_table(spark, sf)).select("metric", "k", r6("value"), "n")


@query("agg_05", """SELECT round((SELECT avg(success::INT) FROM v_attempts), 6) + 0.0 AS parse_success_rate,
    round((SELECT count(*) FROM v_predictions)::DOUBLE / (SELECT count(*) FROM v_cases), 6) + 0.0 AS predictions_per_case,
    (SELECT count(*) FROM v_reasons WHERE trim(reasoning) <> '') AS with_reasoning,
    round((SELECT avg(m) FROM (SELECT avg(length(reasoning)) AS m FROM v_reasons WHERE trim(reasoning) <> ''
        GROUP BY case_id)), 6) + 0.0 AS mean_reasoning_length,
    (SELECT count(*) FROM v_r3 WHERE value < 0.3::DOUBLE) AS low_reward_cases,
    (SELECT count(*) FROM v_r3 WHERE value >= 0.7::DOUBLE) AS high_reward_cases""", {**VIEWS,
    "v_reasons": "SELECT case_id, label AS reasoning FROM v_predictions",
    "v_r3": "SELECT * FROM v_metric_rows WHERE metric = 'combined' AND k = 3"})
def agg_05(spark, sf):
    cases = fx.cases(spark, sf)
    texts = fx.predictions(spark, sf).select("case_id", F.col("label").alias("reasoning"))
    at3 = rk.reward_at_k(sh.rewards(spark, sf), cases, "combined", 3).filter("k = 3")
    out = cm.run_summary(fx.attempts(spark, sf), texts, at3, cases)
    return out.select(r6("parse_success_rate"), r6("predictions_per_case"), "with_reasoning",
                      r6("mean_reasoning_length"), "low_reward_cases", "high_reward_cases")


def answers(spark, sf):
    """Fixture MCQ answers: the segment's place in the alphabet as the letter, the nation as subject."""
    letter = {"AUTOMOBILE": "A", "BUILDING": "B", "FURNITURE": "C", "HOUSEHOLD": "D"}
    answer = F.lit(None).cast("string")
    for name, x in letter.items():
        answer = F.when(F.col("c_mktsegment") == name, x).otherwise(answer)
    key = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("c_custkey") % 4 + 1).cast("int"))
    nation = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    subject = F.when(F.col("n_name").startswith("A"), "").otherwise(F.col("n_name"))
    return fx.table(spark, sf, "customer").join(nation, "c_nationkey", "left").select(
        F.col("c_custkey").alias("case_id"), answer.alias("answer"), key.alias("gold_answer"), subject.alias("subject")
    ).withColumn("correct", F.col("answer") == F.col("gold_answer"))


ANSWER_VIEWS = {"v_answers": """SELECT *, answer = gold_answer AS correct FROM (SELECT c_custkey AS case_id,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A' WHEN 'BUILDING' THEN 'B' WHEN 'FURNITURE' THEN 'C'
        WHEN 'HOUSEHOLD' THEN 'D' END AS answer, substr('ABCD', (c_custkey % 4 + 1)::INT, 1) AS gold_answer,
    CASE WHEN n_name LIKE 'A%' THEN '' ELSE n_name END AS subject
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""}


@query("agg_06", """SELECT coalesce(answer, 'unparsed') AS answer, count(*) AS n, count(CASE WHEN correct THEN 1 END) AS n_correct,
    round(count(*)::DOUBLE / (SELECT count(*) FROM v_answers), 6) + 0.0 AS share FROM v_answers GROUP BY 1""", ANSWER_VIEWS)
def agg_06(spark, sf):
    return cm.answer_distribution(answers(spark, sf)).select("answer", "n", "n_correct", r6("share"))


@query("agg_07", """SELECT CASE WHEN grouping(s) = 1 THEN '(all)' ELSE s END AS subject, count(*) AS n,
    count(CASE WHEN correct THEN 1 END) AS n_correct, round(avg(coalesce(correct, false)::INT), 6) + 0.0 AS accuracy
    FROM (SELECT CASE WHEN trim(coalesce(subject, '')) = '' THEN 'unknown' ELSE trim(subject) END AS s, correct FROM v_answers)
    GROUP BY ROLLUP (s)""", ANSWER_VIEWS)
def agg_07(spark, sf):
    return cm.accuracy_by_subject(answers(spark, sf)).select("subject", "n", "n_correct", r6("accuracy"))


@query("agg_11", """SELECT model, cond, count(*) AS n, round(avg((g_max > 0.5::DOUBLE)::INT), 6) + 0.0 AS grounded,
    round(avg((abs(g_max) <= 0.5::DOUBLE)::INT), 6) + 0.0 AS weak, round(avg((g_max < -0.5::DOUBLE)::INT), 6) + 0.0 AS contradicted,
    round(avg(g_max), 6) + 0.0 AS mean, round(stddev_pop(g_max), 6) + 0.0 AS std,
    round(quantile_cont(g_max, 0.5), 6) + 0.0 AS median, min(g_max) AS min, max(g_max) AS max
    FROM v_judged_run GROUP BY 1, 2""", VIEWS)
def agg_11(spark, sf):
    out = cm.distribution(sh.judged_with_run(spark, sf), "g_max", 0.5, ("model", "cond"))
    return out.select("model", "cond", "n", *[r6(c) for c in ("grounded", "weak", "contradicted", "mean", "std", "median")],
                      "min", "max")


@query("agg_12", """SELECT model, cond, CASE WHEN grouping(matched) = 1 THEN 'overall' WHEN matched THEN 'correct'
        ELSE 'incorrect' END AS "group", count(*) AS n, round(avg(g_avg), 6) + 0.0 AS mean,
    round(stddev_pop(g_avg) / sqrt(count(*)), 6) + 0.0 AS std_error
    FROM v_judged_run GROUP BY GROUPING SETS ((model, cond, matched), (model, cond))""", VIEWS)
def agg_12(spark, sf):
    out = cm.grounding_by_correctness(sh.judged_with_run(spark, sf), "g_avg")
    return out.select("model", "cond", "group", "n", r6("mean"), r6("std_error"))


@query("agg_13", """SELECT model, count(*) AS n, count(CASE WHEN matched THEN 1 END) AS n_correct,
    count(CASE WHEN NOT matched THEN 1 END) AS n_incorrect,
    round(avg(CASE WHEN matched THEN g_avg END), 6) + 0.0 AS mean_correct,
    round(avg(CASE WHEN NOT matched THEN g_avg END), 6) + 0.0 AS mean_incorrect,
    round(avg((g_avg > 0.2::DOUBLE)::INT), 6) + 0.0 AS share_above, round(avg((g_avg < -0.2::DOUBLE)::INT), 6) + 0.0 AS share_below
    FROM v_judged_run GROUP BY 1""", VIEWS)
def agg_13(spark, sf):
    out = cm.model_scatter(sh.judged_with_run(spark, sf), "g_avg")
    return out.select("model", "n", "n_correct", "n_incorrect",
                      *[r6(c) for c in ("mean_correct", "mean_incorrect", "share_above", "share_below")])


@query("top_04", """SELECT label, support, round(f1, 6) + 0.0 AS f1,
    row_number() OVER (ORDER BY round(f1, 9) DESC, label) AS place FROM v_label_f""", LABEL_VIEWS)
def top_04(spark, sf):
    from ..operators.topk import ordered_labels
    return ordered_labels(label_table(spark, sf), "f1").select("label", "support", r6("f1"), "place")


@query("top_05", "SELECT label, count(*) AS count FROM v_gold GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_05(spark, sf):
    return rk.top_labels(fx.gold(spark, sf), 10)


@query("top_06", """(SELECT label, support, 'best' AS side FROM v_label_f ORDER BY support DESC, label LIMIT 5)
    UNION ALL (SELECT label, support, 'worst' FROM v_label_f ORDER BY support, label LIMIT 5)""", LABEL_VIEWS)
def top_06(spark, sf):
    from ..operators.topk import best_and_worst
    return best_and_worst(label_table(spark, sf), "support", 5).select("label", "support", "side")
