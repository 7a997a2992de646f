"""Statistics queries (STA, WIN-06, TAX-03/04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import distributions as ds
from ..operators import stats as st
from . import shared as sh
from .registry import query
from .shared import VIEWS, r6



def row_id():
    return F.xxhash64("case_id", "rnk")


def scored(spark, sf):
    return fx.predictions(spark, sf).join(fx.cases(spark, sf), "case_id")


STA = {
    **VIEWS,
    "v_run": "SELECT p.*, model, cond FROM v_predictions p JOIN v_cases USING (case_id)",
    "v_mom": "SELECT model, count(*) AS n, avg(g_avg) AS m, var_samp(g_avg) AS v FROM v_run GROUP BY 1",
    "v_two": "SELECT a.model AS a, b.model AS b, a.n AS n1, b.n AS n2, a.m - b.m AS d, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS s2 FROM v_mom a JOIN v_mom b ON a.model < b.model",
    "v_rank": "SELECT *, rank() OVER (ORDER BY g_avg) + (count(*) OVER (PARTITION BY g_avg) - 1) / 2.0::DOUBLE AS r FROM v_run",
    "v_ties": "SELECT sum(c * c * c - c) AS t, sum(c) AS n FROM (SELECT count(*)::DOUBLE AS c FROM v_run GROUP BY g_avg)",
    "v_rank2": "SELECT *, rank() OVER (ORDER BY g_avg) + (count(*) OVER (PARTITION BY g_avg) - 1) / 2.0::DOUBLE AS r FROM v_run WHERE cond IN ('baseline', 'rag')",
    "v_ties2": "SELECT sum(c * c * c - c) AS t, sum(c) AS n FROM (SELECT count(*)::DOUBLE AS c FROM v_rank2 GROUP BY g_avg)",
}


@query("sta_01", """SELECT model, count(*) AS n, round(avg(g_avg), 6) + 0.0 AS mean, round(quantile_cont(g_avg, 0.5), 6) + 0.0 AS median,
    round(stddev_samp(g_avg), 6) + 0.0 AS std, min(g_avg) AS min, max(g_avg) AS max, round(quantile_cont(g_avg, 0.25), 6) + 0.0 AS q1,
    round(quantile_cont(g_avg, 0.75), 6) + 0.0 AS q3 FROM v_run GROUP BY 1""", STA)
def sta_01(spark, sf):
    out = st.describe(scored(spark, sf), "g_avg", ("model",))
    return out.select("model", "n", r6("mean"), r6("median"), r6("std"), "min", "max", r6("q1"), r6("q3"))


@query("sta_02")
def sta_02(spark, sf):
    return st.bootstrap_ci(scored(spark, sf), "g_avg", row_id(), ("model", "cond"), 1000)


def pairs(spark, sf):
    return st.pooled(st.group_pairs(st.moments(scored(spark, sf), "g_avg", "model"), "model"))


@query("sta_03", "SELECT a, b, round(d / sqrt(s2), 6) + 0.0 AS cohens_d FROM v_two", STA)
def sta_03(spark, sf):
    return pairs(spark, sf).select(F.col("a_model").alias("a"), F.col("b_model").alias("b"), r6("cohens_d"))


# Student's tail by Simpson's rule, as a second derivation of the p value.
T_TAIL = """(SELECT 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * pow(1 + pow(abs(t) * i / 2000, 2) / df, -(df + 1) / 2)) * abs(t) / 6000 FROM range(2001) s(i))"""


@query("sta_04", f"""SELECT a, b, df::BIGINT AS df, round(t, 6) + 0.0 AS t, round({T_TAIL}, 6) + 0.0 AS p FROM (SELECT a, b, (n1 + n2 - 2)::DOUBLE AS df,
    d / sqrt(s2 * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t FROM v_two)""", STA)
def sta_04(spark, sf):
    return pairs(spark, sf).select(F.col("a_model").alias("a"), F.col("b_model").alias("b"), "df", r6("t"), r6("p"))


@query("win_06", "SELECT g_avg AS value, count(*) AS n, round(min(r), 6) + 0.0 AS rank FROM v_rank GROUP BY 1", STA)
def win_06(spark, sf):
    return st.average_ranks(scored(spark, sf), "g_avg").select("value", "n", r6("rank"))


@query("sta_05", """SELECT n1, n2, round(u, 6) + 0.0 AS u, round((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))), 6) + 0.0 AS z FROM (
    SELECT sum((cond = 'baseline')::INT)::DOUBLE AS n1, sum((cond = 'rag')::INT)::DOUBLE AS n2,
        sum(CASE WHEN cond = 'baseline' THEN r ELSE 0 END) - sum((cond = 'baseline')::INT)::DOUBLE * (sum((cond = 'baseline')::INT)::DOUBLE + 1) / 2 AS u,
        (SELECT t FROM v_ties2) AS t FROM v_rank2)""", STA)
def sta_05(spark, sf):
    out = st.mann_whitney(scored(spark, sf), "g_avg", "cond", "baseline", "rag")
    return out.select("n1", "n2", r6("u"), r6("z"))


def sql_polynomial(coefficients, x):
    """Lowest power first."""
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in coefficients[-2::-1]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def sql_ratio(pair, x):
    return f"{sql_polynomial(pair[0], x)} / {sql_polynomial(pair[1], x)}"


# Shapiro-Wilk row by row: normal scores of the ranks, weights, statistic and the scale of its p value.
SHAPIRO = {
    **STA,
    "v_order": """SELECT model, g_avg AS x, row_number() OVER (PARTITION BY model ORDER BY g_avg) AS i, count(*) OVER (PARTITION BY model) AS n,
        avg(g_avg) OVER (PARTITION BY model) AS mean FROM v_run""",
    "v_prob": "SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) - 0.5::DOUBLE AS q FROM v_order",
    "v_tail": "SELECT *, 0.180625::DOUBLE - q * q AS mid, sqrt(-ln(least(p, 1 - p))) AS r FROM v_prob",
    "v_score": f"""SELECT *, CASE WHEN abs(q) <= 0.425::DOUBLE THEN q * {sql_ratio(ds.QUANTILE_MIDDLE, 'mid')}
        WHEN r <= 5 THEN sign(q) * {sql_ratio(ds.QUANTILE_NEAR, '(r - 1.6::DOUBLE)')} ELSE sign(q) * {sql_ratio(ds.QUANTILE_FAR, '(r - 5)')} END AS m FROM v_tail""",
    "v_outer": f"""SELECT model, any_value(n)::DOUBLE AS n, sum(m * m) AS squares, max(m) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2,
        max(m) / sqrt(sum(m * m)) + {sql_polynomial((0.0, *st.OUTER_WEIGHT), '(1 / sqrt(any_value(n)))')} AS a1,
        max(CASE WHEN i = n - 1 THEN m END) / sqrt(sum(m * m)) + {sql_polynomial((0.0, *st.SECOND_WEIGHT), '(1 / sqrt(any_value(n)))')} AS a2 FROM v_score GROUP BY 1""",
    "v_weighed": """SELECT s.model, s.n, x, mean, CASE WHEN i = 1 THEN -a1 WHEN i = s.n THEN a1 WHEN i = 2 THEN -a2 WHEN i = s.n - 1 THEN a2
        ELSE m / sqrt((squares - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS a FROM v_score s JOIN v_outer o ON s.model = o.model""",
    "v_w": "SELECT model, any_value(n) AS n, pow(sum(a * x), 2) / sum((x - mean) * (x - mean)) AS w FROM v_weighed GROUP BY 1",
}


@query("sta_06", f"""SELECT model, n, round(w, 6) + 0.0 AS w, (ln(1 - w) - {sql_polynomial(st.MANY_MEAN, 'ln(n)')}) / exp({sql_polynomial(st.MANY_SPREAD, 'ln(n)')}) < 1.6448536269514722::DOUBLE AS normal
    FROM v_w""", SHAPIRO)
def sta_06(spark, sf):
    """Groups of 12 rows or more, as all of these are."""
    return st.normality(scored(spark, sf), "g_avg", "model").select("model", "n", r6("w"), "normal")


@query("sta_07", """SELECT (k - 1)::DOUBLE AS df1, (n - k)::DOUBLE AS df2, round((b / (k - 1)) / (w / (n - k)), 6) + 0.0 AS f FROM (
    SELECT count(*) AS k, sum(n) AS n, sum(n * pow(m - (SELECT avg(g_avg) FROM v_run), 2)) AS b, sum((n - 1) * v) AS w FROM v_mom)""", STA)
def sta_07(spark, sf):
    return st.anova(scored(spark, sf), "g_avg", "model").select("df1", "df2", r6("f"))


@query("sta_08", """SELECT (count(*) - 1)::DOUBLE AS df, round((12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / m) - 3 * (any_value(n) + 1))
    / (1 - any_value(t) / (any_value(n) * any_value(n) * any_value(n) - any_value(n))), 6) + 0.0 AS h FROM (SELECT model, count(*) AS m, sum(r) AS rs FROM v_rank GROUP BY 1), v_ties""", STA)
def sta_08(spark, sf):
    return st.kruskal(scored(spark, sf), "g_avg", "model").select("df", r6("h"))


@query("sta_09", f"""SELECT a, b, round(t, 6) + 0.0 AS t, p < 0.05 / 3 AS significant FROM (SELECT *, {T_TAIL} AS p FROM (SELECT a, b, (n1 + n2 - 2)::DOUBLE AS df,
    d / sqrt(s2 * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t FROM v_two_q))""", {**STA,
    "v_band": "SELECT *, CASE WHEN g_max > 0.5::DOUBLE THEN 'high' WHEN g_max < -0.5::DOUBLE THEN 'low' ELSE 'mid' END AS band FROM v_run",
    "v_mom_q": "SELECT band AS model, count(*) AS n, avg(g_avg) AS m, var_samp(g_avg) AS v FROM v_band GROUP BY 1",
    "v_two_q": STA["v_two"].replace("v_mom", "v_mom_q")})
def sta_09(spark, sf):
    """Mean grounding between bands of the strongest sentence."""
    g = F.col("g_max")
    rows = scored(spark, sf).withColumn("band", F.when(g > 0.5, "high").when(g < -0.5, "low").otherwise("mid"))
    out = st.post_hoc(rows, "g_avg", "band", st.anova(rows, "g_avg", "band"))
    return out.select(F.col("a_band").alias("a"), F.col("b_band").alias("b"), r6("t"), "significant")


@query("sta_10")
def sta_10(spark, sf):
    from ..operators.pairs import aligned_metrics
    runs = sh.judged_with_run(spark, sf).groupBy(F.col("subject_id").alias("case_id"), F.col("cond").alias("run")).agg(F.avg("g_max").alias("value"))
    paired = st.paired_difference_ci(aligned_metrics(runs, ["baseline", "rag"]), "rag", "baseline").select(
        F.lit("paired").alias("kind"), "lower", "upper")
    free = st.independent_difference_ci(scored(spark, sf), "g_max", "cond", "rag", "baseline", row_id()).select(
        F.lit("independent").alias("kind"), "lower", "upper")
    return paired.unionByName(free)


@query("sta_11", """SELECT a, b, round(r, 6) + 0.0 AS r FROM (SELECT 'g_max' AS a, 'g_avg' AS b, corr(g_max, g_avg) AS r FROM v_rewards UNION ALL
    SELECT 'g_max', 'combined', corr(g_max, combined) FROM v_rewards UNION ALL SELECT 'g_avg', 'combined', corr(g_avg, combined) FROM v_rewards
    UNION ALL SELECT x, x, 1.0 FROM (VALUES ('g_max'), ('g_avg'), ('combined')) t(x))""", STA)
def sta_11(spark, sf):
    return st.correlations(sh.rewards(spark, sf), ["g_max", "g_avg", "combined"]).select("a", "b", r6("r"))


@query("sta_12", """SELECT role, n, round(slope, 6) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept, round(r, 6) + 0.0 AS r FROM (
    SELECT lang AS role, count(*) AS n, regr_slope(len, n_chars) AS slope, regr_intercept(len, n_chars) AS intercept, corr(len, n_chars) AS r FROM (
        SELECT lang, n_chars, length(replace(text, ' ', '')) AS len FROM documents) GROUP BY 1) WHERE n > 2""")
def sta_12(spark, sf):
    rows = fx.table(spark, sf, "documents").select(
        F.col("lang").alias("role"), F.col("n_chars").cast("double").alias("x"), F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("double").alias("y"))
    return st.regression(rows, "y", "x", ("role",)).select("role", "n", r6("slope"), (F.round("intercept", 4) + 0.0).alias("intercept"), r6("r"))


@query("tax_03")
def tax_03(spark, sf):
    from ..plans.jobs import model_rows
    return model_rows(sh.judged_with_run(spark, sf), row_id())


@query("tax_04")
def tax_04(spark, sf):
    from ..plans.jobs import metric_intervals
    from .metrics import metric_table
    return metric_intervals(metric_table(spark, sf))
