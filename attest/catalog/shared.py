"""Frames and helpers the query definitions share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixtures as fx
from ..operators import grounding as gr, ranking as rk


def r6(column, name: str | None = None) -> Column:
    """Six digits and no negative zero: sums differ beyond that between engines. The nudge makes
    exact halves, such as the mean of two six-digit scores, round the same way in both."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c + 1.3e-10, 6) + 0.0).alias(name or (column if isinstance(column, str) else "value"))


def judged(spark, sf) -> DataFrame:
    return rk.label_verdicts(fx.predictions(spark, sf), fx.gold(spark, sf))


def case_gold_counts(spark, sf) -> DataFrame:
    return rk.gold_counts(fx.cases(spark, sf), fx.gold(spark, sf))


def tally(spark, sf, max_k: int = 5) -> DataFrame:
    return rk.tally_at_k(judged(spark, sf), case_gold_counts(spark, sf), max_k)


def judged_with_run(spark, sf) -> DataFrame:
    return judged(spark, sf).join(fx.cases(spark, sf), "case_id")


def rewards(spark, sf) -> DataFrame:
    grounded = fx.predictions(spark, sf)
    return gr.reward_rows(grounded, judged(spark, sf))


# SQL counterparts of the frames above.
VIEWS = {
    "v_judged": """SELECT p.*, g.label IS NOT NULL AS matched FROM v_predictions p
        LEFT JOIN v_gold g ON p.case_id = g.case_id AND p.label = g.label""",
    "v_ks": "SELECT k FROM range(1, 6) t(k)",
    "v_ngold": """SELECT c.case_id, count(DISTINCT g.label) AS n_gold FROM v_cases c
        LEFT JOIN v_gold g ON c.case_id = g.case_id GROUP BY 1""",
    "v_tally": """SELECT c.case_id, k, n_gold, count(j.rnk) AS n_pred,
        count(CASE WHEN matched THEN 1 END) AS hits, count(DISTINCT CASE WHEN matched THEN label END) AS covered
        FROM v_ngold c CROSS JOIN v_ks LEFT JOIN v_judged j ON c.case_id = j.case_id AND j.rnk <= k
        GROUP BY 1, 2, 3""",
    "v_pr": """SELECT case_id, k, CASE WHEN n_pred > 0 AND n_gold > 0 THEN hits::DOUBLE / n_pred ELSE 0.0::DOUBLE END AS p,
        CASE WHEN n_pred > 0 AND n_gold > 0 THEN covered::DOUBLE / n_gold ELSE 0.0::DOUBLE END AS r FROM v_tally""",
    "v_judged_run": "SELECT j.*, subject_id, model, cond FROM v_judged j JOIN v_cases USING (case_id)",
    "v_rewards": """SELECT case_id, rnk, label, matched, g_max, g_avg,
        CASE WHEN matched THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS precision,
        0.5::DOUBLE * g_max + 0.5::DOUBLE * CASE WHEN matched THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS combined
        FROM v_judged""",
    "v_metric_rows": """SELECT case_id, 'precision' AS metric, k, p AS value FROM v_pr
        UNION ALL SELECT case_id, 'recall', k, r FROM v_pr
        UNION ALL SELECT case_id, 'f1', k, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END FROM v_pr
        UNION ALL SELECT case_id, m, k, coalesce(avg(v), 0.0::DOUBLE) FROM (
            SELECT c.case_id, k, m, CASE m WHEN 'g_max' THEN g_max WHEN 'g_avg' THEN g_avg
                WHEN 'reward_precision' THEN precision ELSE combined END AS v
            FROM v_cases c CROSS JOIN v_ks CROSS JOIN
                (VALUES ('g_max'), ('g_avg'), ('reward_precision'), ('combined')) t(m)
            LEFT JOIN v_rewards w ON w.case_id = c.case_id AND w.rnk <= k) GROUP BY 1, 2, 3""",
}
