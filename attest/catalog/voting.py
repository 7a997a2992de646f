"""Voting and routing queries (VOT, RTE, AGG-15/16, JOB-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import extraction as ex, routing as ro, voting as vo
from .extraction import CRITIQUES, critiques, outputs
from .registry import query
from .shared import r6
from .vectors import VEC


def label_vectors(spark, sf):
    """Fixture label vectors: the embeddings of ids 0-24 for the 25 brands, neighbours in pairs alike."""
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    brand = fx.table(spark, sf, "part").select(F.col("p_brand").alias("label")).distinct().withColumn(
        "id", F.floor(F.regexp_extract("label", r"(\d+)$", 1).cast("bigint") / 2))
    return brand.join(e, "id").select("label", "vector")


# Labels whose numbers halve to one id share a vector, so a case's cluster is the pair of brands; its
# leader is the more frequent one. Different ids stay apart: their cosine is below the threshold.
VOTE = {
    **VEC,
    "v_vc": "SELECT case_id, label, count(*) AS n, regexp_extract(label, '(\\d+)$', 1)::BIGINT // 2 AS id FROM v_votes GROUP BY 1, 2",
    "v_cl": """SELECT case_id, label, first_value(label) OVER (PARTITION BY case_id, id ORDER BY n DESC, label) AS leader FROM v_vc""",
    "v_vstat": """SELECT case_id, leader, count(DISTINCT sample_idx) AS vote_count, avg(position) AS avg_position,
        arg_max(reasoning, {'a': (position <= 1)::INT, 'b': length(reasoning), 'c': -(sample_idx * 1000 + position)}) AS best_reasoning
        FROM v_votes JOIN v_cl USING (case_id, label) GROUP BY 1, 2""",
}


def clusters(spark, sf):
    return vo.lead_clusters(fx.votes(spark, sf), label_vectors(spark, sf), 0.95)


def statistics(spark, sf):
    return vo.cluster_statistics(fx.votes(spark, sf), clusters(spark, sf))


def parsed_samples(spark, sf):
    """Attempts as parsed lists, one per case and sample."""
    lists = fx.votes(spark, sf).groupBy("case_id", "sample_idx").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("position", "label", "reasoning"))), lambda v: F.struct(v["label"].alias("label"), v["reasoning"].alias("reasoning"))).alias("items"))
    return lists.withColumn("parse_success", F.size("items") >= 3)


@query("vot_01", """SELECT case_id, sample_idx, position, label, reasoning FROM v_votes
    QUALIFY count(*) OVER (PARTITION BY case_id, sample_idx) >= 3""")
def vot_01(spark, sf):
    return vo.pool_votes(parsed_samples(spark, sf))


@query("vot_02", "SELECT case_id, label, leader FROM v_cl", VOTE)
def vot_02(spark, sf):
    return clusters(spark, sf)


@query("vot_03", """SELECT case_id, leader, rnk, round(score, 6) + 0.0 AS score, n >= 3 AS success FROM (SELECT *, 100 * vote_count - avg_position AS score,
    row_number() OVER (PARTITION BY case_id ORDER BY round(100 * vote_count - avg_position, 9) DESC, leader) AS rnk, count(*) OVER (PARTITION BY case_id) AS n FROM v_vstat)
    WHERE rnk <= 5""", VOTE)
def vot_03(spark, sf):
    return vo.winners(statistics(spark, sf)).select("case_id", "leader", "rnk", r6("score"), "success")


@query("vot_04", "SELECT case_id, leader, best_reasoning FROM v_vstat", VOTE)
def vot_04(spark, sf):
    return statistics(spark, sf).select("case_id", "leader", "best_reasoning")


@query("agg_15", "SELECT case_id, leader AS canonical, vote_count, round(avg_position, 6) + 0.0 AS avg_position FROM v_vstat", VOTE)
def agg_15(spark, sf):
    return statistics(spark, sf).select("case_id", "canonical", "vote_count", r6("avg_position"))


AUDIT = {**VOTE, "v_audit": """SELECT case_id, count(*) FILTER (n >= 3) AS n_parsed, count(*) FILTER (n < 3) AS n_failed, sum(n)::BIGINT AS n_pooled,
    any_value(c) AS n_clusters FROM (SELECT case_id, sample_idx, count(*) AS n FROM v_votes GROUP BY 1, 2)
    JOIN (SELECT case_id, count(*) AS c FROM v_vstat GROUP BY 1) USING (case_id) GROUP BY 1"""}


def audits(spark, sf):
    return vo.audit(parsed_samples(spark, sf), fx.votes(spark, sf), statistics(spark, sf))


@query("vot_05", "SELECT * FROM v_audit", AUDIT)
def vot_05(spark, sf):
    return audits(spark, sf)


@query("agg_16", """SELECT count(*) AS n_cases, round(sum(n_parsed)::DOUBLE / sum(n_parsed + n_failed), 6) + 0.0 AS parse_rate,
    round(avg(n_clusters), 6) + 0.0 AS clusters_per_case, round(avg((n_clusters >= 3)::INT), 6) + 0.0 AS success_rate FROM v_audit""", AUDIT)
def agg_16(spark, sf):
    return vo.run_rates(audits(spark, sf)).select("n_cases", r6("parse_rate"), r6("clusters_per_case"), r6("success_rate"))


@query("job_08", """SELECT case_id, rnk, leader AS label, vote_count FROM (SELECT *, row_number() OVER (PARTITION BY case_id
    ORDER BY round(100 * vote_count - avg_position, 9) DESC, leader) AS rnk FROM v_jstat) WHERE rnk <= 5""", {**VOTE,
    "v_jvotes": "SELECT * FROM v_votes QUALIFY count(*) OVER (PARTITION BY case_id, sample_idx) >= 3",
    "v_jc": "SELECT case_id, label, count(*) AS n, regexp_extract(label, '(\\d+)$', 1)::BIGINT // 2 AS id FROM v_jvotes GROUP BY 1, 2",
    "v_jcl": "SELECT case_id, label, first_value(label) OVER (PARTITION BY case_id, id ORDER BY n DESC, label) AS leader FROM v_jc",
    "v_jstat": "SELECT case_id, leader, count(DISTINCT sample_idx) AS vote_count, avg(position) AS avg_position FROM v_jvotes JOIN v_jcl USING (case_id, label) GROUP BY 1, 2"})
def job_08(spark, sf):
    from ..plans.jobs import self_consistency
    return self_consistency(parsed_samples(spark, sf), label_vectors(spark, sf), 0.95).select("case_id", "rnk", F.col("canonical").alias("label"), "vote_count")


ROUTE = {**CRITIQUES,
         "v_odd": "SELECT * FROM v_critiques WHERE case_id % 2 = 1",
         "v_full": """SELECT * FROM v_odd UNION ALL SELECT case_id, rnk - 1, label, 'LOW', true FROM v_predictions p
            WHERE NOT EXISTS (SELECT 1 FROM v_odd o WHERE o.case_id = p.case_id)""",
         "v_routes": "SELECT case_id, bool_or(needs_evidence) AS needs_retrieval, count(CASE WHEN needs_evidence THEN 1 END) AS n_uncertain FROM v_critiques GROUP BY 1"}


@query("rte_01", "SELECT case_id, critique_idx, label, confidence, needs_evidence FROM v_full", ROUTE)
def rte_01(spark, sf):
    """Critiques of even cases are taken as unreadable."""
    return ro.with_fallback(fx.predictions(spark, sf), critiques(spark, sf).filter("case_id % 2 = 1"))


@query("rte_02", "SELECT * FROM v_routes", ROUTE)
def rte_02(spark, sf):
    return ro.routed(critiques(spark, sf))


@query("rte_03", """SELECT case_id, CASE WHEN count(CASE WHEN needs_evidence THEN 1 END) > 0 THEN string_agg(CASE WHEN needs_evidence THEN p.label || '. at ' || rnk END, ' ' ORDER BY rnk)
    ELSE string_agg('at ' || rnk, ' ' ORDER BY rnk) END AS text FROM v_predictions p JOIN v_critiques c USING (case_id) WHERE c.critique_idx = p.rnk - 1 GROUP BY 1""", ROUTE)
def rte_03(spark, sf):
    predictions = fx.predictions(spark, sf).withColumn("reasoning", F.concat(F.lit("at "), "rnk"))
    return ro.retrieval_queries(predictions, critiques(spark, sf))


@query("rte_04", """SELECT case_id, needs_retrieval AS triggered, needs_retrieval AND n >= 3 AND case_id % 2 = 0 AS replaced, n_uncertain FROM v_routes
    JOIN (SELECT case_id, count(*) AS n FROM v_predictions GROUP BY 1) USING (case_id)""", ROUTE)
def rte_04(spark, sf):
    """Refined outputs exist for even cases; they replace the first ones where they parse."""
    initial = ex.parse_attempts(outputs(spark, sf))
    routes = ro.routed(critiques(spark, sf))
    refined = initial.filter("case_id % 2 = 0").join(routes.filter("needs_retrieval").select("case_id"), "case_id", "left_semi")
    return ro.keep_or_replace(initial, refined, routes).select("case_id", "triggered", "replaced", "n_uncertain")


@query("rte_05", "SELECT case_id, count(*) AS n_items FROM v_votes WHERE sample_idx = 0 GROUP BY 1")
def rte_05(spark, sf):
    return ro.primary(parsed_samples(spark, sf)).select("case_id", F.size("items").cast("bigint").alias("n_items"))
