"""Whole runs (JOB) and the streaming monitors (STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as tx
from ..plans import jobs
from ..session import scratch_path
from ..streaming import monitors as mo, tracker as tk
from . import shared as sh
from .grounding import NLI
from .judging import BIN_VIEWS
from .metrics import KIND_VIEWS, by_kind
from .pairs import note_evidence
from .registry import query
from .retrieval import FUSED, RET, corpus, items
from .shared import VIEWS, r6
from .texts import NOTE


@query("job_01", """SELECT kind, k, round(avg(CASE WHEN n > 0 AND n_gold > 0 THEN hits::DOUBLE / n ELSE 0.0::DOUBLE END), 6) + 0.0 AS precision,
        round(avg(CASE WHEN n > 0 AND n_gold > 0 THEN hits::DOUBLE / n_gold ELSE 0.0::DOUBLE END), 6) + 0.0 AS recall, count(*) AS n_cases FROM (
    SELECT c.case_id, t.kind, k, (SELECT count(*) FROM v_kgold g WHERE g.case_id = c.case_id AND g.kind = t.kind) AS n_gold,
        count(p.rnk) AS n, count(g.label) AS hits
    FROM v_cases c CROSS JOIN v_ks CROSS JOIN (VALUES ('diagnosis'), ('procedure')) t(kind)
    LEFT JOIN v_kpred p ON p.case_id = c.case_id AND p.kind = t.kind AND p.rnk <= k
    LEFT JOIN v_kgold g ON g.case_id = c.case_id AND g.kind = t.kind AND g.label = p.label
    GROUP BY 1, 2, 3) GROUP BY 1, 2""", {**VIEWS, **KIND_VIEWS})
def job_01(spark, sf):
    """Outputs of both label kinds are written as text lists, parsed, judged and averaged."""
    lists = by_kind(fx.predictions(spark, sf)).groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "diagnosis", F.struct("rnk", "label")))).alias("d"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "procedure", F.struct("rnk", "label")))).alias("p"))

    def numbered(name):
        return F.array_join(F.transform(name, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["label"])), "\n")
    outputs = lists.select("case_id", F.concat(F.lit("Diagnoses:\n"), numbered("d"), F.lit("\n\nProcedures:\n"), numbered("p")).alias("raw_output"))
    return jobs.ranked_list_run(outputs, by_kind(fx.gold(spark, sf)), fx.cases(spark, sf)).select(
        "kind", "k", r6("precision"), r6("recall"), "n_cases")


@query("job_02", r"""SELECT item_id AS case_id, md5(concat('List the 5 most likely diagnoses as JSON with name and reasoning.', chr(10), chr(10), 'Patient:', chr(10), b.text,
    chr(10), chr(10), 'Retrieved evidence:', chr(10), block, chr(10), chr(10), 'IMPORTANT: answer with JSON only.')) AS digest FROM benchmark b JOIN (
    SELECT case_id, string_agg('Evidence ' || rnk || ':' || chr(10) || trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY rnk) AS block FROM (
        SELECT case_id, d.text, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, f.doc_id) AS rnk FROM (
            SELECT case_id, doc_id, max(score) AS score FROM v_phits GROUP BY 1, 2) f JOIN documents d ON d.doc_id = f.doc_id) WHERE rnk <= 5 GROUP BY 1)
    ON case_id = item_id""", FUSED)
def job_02(spark, sf):
    cases = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("context"))
    parts = cases.select("case_id", F.posexplode(tx.sentences(F.col("context"))).alias("part_idx", "text"))
    return jobs.fused_prompts(cases, parts, corpus(spark, sf), 5).select("case_id", F.md5("prompt").alias("digest"))


@query("job_03", r"""SELECT n.case_id, cond, md5(concat('List the 5 most likely diagnoses as JSON with name and reasoning.', chr(10), chr(10), 'Patient:', chr(10), c,
    CASE WHEN cond = 'baseline' THEN '' ELSE concat(chr(10), chr(10), 'Retrieved evidence:', chr(10), coalesce(block, 'No documents provided.')) END,
    chr(10), chr(10), 'IMPORTANT: answer with JSON only.')) AS digest FROM v_clean n CROSS JOIN (VALUES ('baseline'), ('rag'), ('tuned')) t(cond)
    LEFT JOIN (SELECT doc_id, string_agg('Evidence ' || i || ':' || chr(10) || trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY i) AS block FROM (
        SELECT r.doc_id, text, row_number() OVER (PARTITION BY r.doc_id ORDER BY query_id) AS i FROM v_relevance r JOIN benchmark ON item_id = query_id)
        GROUP BY 1) e ON e.doc_id = n.case_id""", NOTE)
def job_03(spark, sf):
    return jobs.prompt_table(fx.notes(spark, sf), note_evidence(spark, sf)).select("case_id", "cond", F.md5("prompt").alias("digest"))


@query("job_04", """SELECT query_id, doc_id, round(score, 6) + 0.0 AS alignment, CASE WHEN query_id % 2 = 0 THEN round(score, 6) + 0.0 ELSE 0.0::DOUBLE END AS reward
    FROM v_hits WHERE rnk = 1""", RET)
def job_04(spark, sf):
    """The answer of an item is its own text; even items are judged correct."""
    asked = items(spark, sf)
    verdicts = asked.select("query_id", (F.col("query_id") % 2 == 0).alias("correct"))
    out = jobs.alignment_run(corpus(spark, sf), asked, asked, verdicts, 5)
    return out.select("query_id", "doc_id", r6("alignment"), r6("reward"))


@query("job_05", """SELECT coalesce(answer, 'unparsed') AS answer, count(*) AS n, count(CASE WHEN answer = gold THEN 1 END) AS n_correct FROM (
    SELECT CASE WHEN judgement_id % 5 = 4 THEN CASE WHEN judgement_id % 2 = 0 THEN 'A' END ELSE substr('ABCD', (judgement_id % 4 + 1)::INT, 1) END AS answer,
        CASE WHEN gold THEN 'A' ELSE 'B' END AS gold FROM v_judgements) GROUP BY 1""")
def job_05(spark, sf):
    """Outputs of every parse route; unparsed even ones are rescued by a second extraction."""
    n = F.col("judgement_id")
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (n % 4 + 1).cast("int"))
    text = (F.when(n % 5 == 0, F.concat(F.lit('{"answer": "'), letter, F.lit('"}'))).when(n % 5 == 1, F.concat(F.lit("Answer: "), letter))
            .when(n % 5 == 2, F.concat(F.lit("The correct is ("), letter, F.lit(")"))).when(n % 5 == 3, F.concat(letter, F.lit(" because"))).otherwise("unsure"))
    rows = fx.judgements(spark, sf)
    outputs = rows.select(n.alias("case_id"), text.alias("raw_output"))
    second = rows.filter(n % 2 == 0).select(n.alias("case_id"), F.lit("A").alias("raw_output"))
    gold = rows.select(n.alias("case_id"), F.when(F.col("gold"), "A").otherwise("B").alias("gold_answer"))
    return jobs.mcq_run(outputs, second, gold).select("answer", "n", "n_correct")


@query("job_06", """SELECT metric, k, round(avg(value), 6) + 0.0 AS value FROM (
    SELECT case_id, 'precision' AS metric, k, p AS value FROM v_pr UNION ALL SELECT case_id, 'recall', k, r FROM v_pr
    UNION ALL SELECT case_id, 'f1', k, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END FROM v_pr
    UNION ALL SELECT case_id, m, k, coalesce(avg(v), 0.0::DOUBLE) FROM (SELECT c.case_id, k, m, CASE m WHEN 'g_max' THEN g.g_max WHEN 'g_avg' THEN g.g_avg
        WHEN 'reward_precision' THEN w.precision ELSE 0.5::DOUBLE * g.g_max + 0.5::DOUBLE * w.precision END AS v FROM v_cases c CROSS JOIN v_ks
        CROSS JOIN (VALUES ('g_max'), ('g_avg'), ('reward_precision'), ('combined')) t(m) LEFT JOIN v_rewards w ON w.case_id = c.case_id AND w.rnk <= k
        LEFT JOIN v_ground g ON g.case_id = w.case_id AND g.rnk = w.rnk) GROUP BY 1, 2, 3) GROUP BY 1, 2""", NLI)
def job_06(spark, sf):
    return jobs.metrics_run(fx.predictions(spark, sf).drop("g_max", "g_avg"), fx.gold(spark, sf), fx.nli_scores(spark, sf), fx.cases(spark, sf)).select(
        "metric", "k", r6("value"))


@query("job_07", """SELECT model, cond, total, round(eb::DOUBLE / total, 6) + 0.0 AS eb_pct, round(h::DOUBLE / total, 6) + 0.0 AS h_pct,
    round(CASE WHEN c > 0 THEN eb::DOUBLE / c ELSE 0 END, 6) + 0.0 AS faithfulness, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, true AS bracketed FROM (
    SELECT model, cond, count(*) FILTER (rnk <= 5) AS total, count(CASE WHEN rnk <= 5 AND matched AND g_max > 0.5::DOUBLE THEN 1 END) AS eb,
        count(CASE WHEN rnk <= 5 AND NOT matched AND g_max < -0.5::DOUBLE THEN 1 END) AS h, count(CASE WHEN rnk <= 5 AND matched THEN 1 END) AS c, avg(g_max) AS mean, stddev_pop(g_max) AS std FROM v_judged_run GROUP BY 1, 2)""", VIEWS)
def job_07(spark, sf):
    out = jobs.report_run(sh.judged_with_run(spark, sf), F.xxhash64("case_id", "rnk"))
    return out.select("model", "cond", "total", *[r6(c) for c in ("eb_pct", "h_pct", "faithfulness", "mean", "std")],
                      F.expr("lower <= mean and mean <= upper and lower < upper").alias("bracketed"))


@query("str_01", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, CASE WHEN success THEN 'success' ELSE CASE attempt_id % 8 WHEN 0 THEN 'empty_output'
    WHEN 2 THEN 'extra_text' ELSE 'incomplete_json' END END AS error_type, count(*) AS n FROM v_attempts GROUP BY 1, 2""")
def str_01(spark, sf):
    path = scratch_path(spark, "attempt-stream")
    mo.replay(fx.attempts(spark, sf), f"{path}/in", lambda s: mo.run_available(mo.parse_monitor(s), path, "update"))
    return mo.latest(spark, path, ["start", "error_type"]).select(
        F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "error_type", "n")


@query("str_01_tracker", """SELECT error_type, count(*) AS n, CASE WHEN error_type = 'success' THEN '' ELSE string_agg(attempt_id || '=' || substr(raw_output, 1, 500), '|' ORDER BY attempt_id)
        FILTER (i <= 3) END AS examples FROM (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY attempt_id) AS i FROM (SELECT *, CASE WHEN success THEN 'success' ELSE
        CASE attempt_id % 8 WHEN 0 THEN 'empty_output' WHEN 2 THEN 'extra_text' ELSE 'incomplete_json' END END AS error_type FROM v_attempts)) GROUP BY 1""")
def str_01_tracker(spark, sf):
    """Attempts as they arrive: how many of each outcome so far, and the first examples of each error."""
    path = scratch_path(spark, "tracker")
    mo.replay(fx.attempts(spark, sf), f"{path}/in", lambda s: mo.run_available(tk.track(s), path, "update"))
    out = tk.tracked(mo.latest(spark, path, ["error_type", "spread"]))
    shown = F.transform("examples", lambda x: F.concat(x["attempt_id"].cast("string"), F.lit("="), x["preview"]))
    return out.select("error_type", "n", F.array_join(shown, "|").alias("examples"))


@query("str_02", """SELECT bin, count(*) AS n, sum(gold::INT)::BIGINT AS n_right, round(sum(confidence), 6) + 0.0 AS sum_confidence,
    (SELECT count(*) FROM v_judgements WHERE confidence < 0.6::DOUBLE) AS n_queued FROM v_binned GROUP BY 1""", BIN_VIEWS)
def str_02(spark, sf):
    path = scratch_path(spark, "judge-stream")

    def step(stream):
        mo.run_available(mo.judge_monitor(stream), f"{path}/bins", "update")
        mo.run_available(mo.review_queue(stream), f"{path}/queue", "append")
    mo.replay(fx.judgements(spark, sf), f"{path}/in", step)
    queued = mo.appended(spark, f"{path}/queue").agg(F.count("*").alias("n_queued"))
    return mo.latest(spark, f"{path}/bins", ["bin"]).join(F.broadcast(queued), F.lit(True)).select(
        "bin", "n", "n_right", r6("sum_confidence"), "n_queued")
