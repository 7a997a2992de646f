"""Whole runs composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixtures as fx
from ..functions import repair as rp, text as tx
from ..operators import casemetrics as cm, cohorts as co, extraction as ex, grounding as gr, lexical as lx, prompts as pm
from ..operators import ranking as rk, retrieval as rt, stats as st, voting as vo


def condition_report(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    """Per condition: precision, recall, F1 and mean grounding at k, and the outcome taxonomy."""
    cases, gold = fx.cases(spark, sf), fx.gold(spark, sf)
    judged = rk.label_verdicts(fx.predictions(spark, sf), gold)
    tally = rk.tally_at_k(judged, rk.gold_counts(cases, gold), k)
    quality = rk.precision_recall(tally).filter(F.col("k") == k)
    reward = rk.reward_at_k(judged, cases, "g_max", k).filter(F.col("k") == k)
    means = cases.join(quality, "case_id").join(reward.select("case_id", "value"), "case_id").groupBy("cond").agg(
        F.count("*").alias("n_cases"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.avg("value").alias("g_max"))
    return means.join(co.taxonomy(judged.join(cases, "case_id"), k, by=("cond",)), "cond")


def mcq_grounding(premises: DataFrame, reasoning: DataFrame, score: Column) -> DataFrame:
    """Grounding of MCQ answers: each reasoning sentence against each premise of its case, with the sentences' scores.

    ``premises`` holds case_id, rnk, premise_idx, premise. A case without reasoning keeps null."""
    sentences = reasoning.select("case_id", "rnk", F.posexplode(tx.sentences_any(F.col("reasoning"))).alias("sentence_idx", "sentence"))
    scored = sentences.join(premises, ["case_id", "rnk"]).withColumn("score", score)
    per_sentence = scored.groupBy("case_id", "rnk", "sentence_idx").agg(
        gr.strongest(F.col("score"), F.col("premise_idx")).alias("score"))
    per_case = per_sentence.groupBy("case_id", "rnk").agg(
        gr.strongest(F.col("score"), F.col("sentence_idx")).alias("g_max"), F.avg("score").alias("g_avg"),
        F.count("*").alias("num_sentences"),
        F.transform(F.sort_array(F.collect_list(F.struct("sentence_idx", "score"))), lambda s: s["score"]).alias("sentence_scores"))
    return reasoning.select("case_id", "rnk").join(per_case, ["case_id", "rnk"], "left")


def model_rows(judged: DataFrame, row_id: Column, k: int = 5, threshold: float = 0.5, replicates: int = 1000) -> DataFrame:
    """One row per model and condition: accuracy, g_max and g_avg with intervals, and the taxonomy."""
    by = ("model", "cond")
    rows = judged.withColumn("accuracy", F.col("matched").cast("double"))
    out = co.taxonomy(rows, k, "g_max", threshold, by)
    for value in ("accuracy", "g_max", "g_avg"):
        ci = st.bootstrap_ci(rows, value, row_id, by, replicates).select(
            *by, F.col("mean").alias(value), F.col("lower").alias(f"{value}_lower"), F.col("upper").alias(f"{value}_upper"))
        out = out.join(ci, list(by))
    return out


def metric_intervals(metric_rows: DataFrame, replicates: int = 1000) -> DataFrame:
    """Metric x k: mean and bootstrap interval over cases."""
    return st.bootstrap_ci(metric_rows, "value", F.xxhash64("case_id"), ("metric", "k"), replicates)


def self_consistency(parsed: DataFrame, vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Winner list per case from parsed samples: pool, cluster, score, top five."""
    votes = vo.pool_votes(parsed)
    return vo.winners(vo.cluster_statistics(votes, vo.lead_clusters(votes, vectors, threshold)))


def ranked_list_run(outputs: DataFrame, gold: DataFrame, cases: DataFrame, max_k: int = 5) -> DataFrame:
    """Text outputs with a list per label kind -> mean precision and recall at k per kind.

    ``gold`` holds case_id, kind, label. A label matches when it equals a gold label of its kind."""
    kinds = {"diagnosis": "Diagnoses", "procedure": "Procedures"}
    text = tx.with_opener(F.col("raw_output"))
    items = F.concat(*[_tagged(tx.ranked_items(text, head, max_k), kind) for kind, head in kinds.items()])
    keys = ("case_id", "kind")
    found = outputs.select("case_id", F.inline(items))
    truth = gold.select("case_id", "kind", "label", F.lit(True).alias("matched")).distinct()
    judged = found.join(truth, ["case_id", "kind", "label"], "left").fillna(False, ["matched"])
    every = cases.select("case_id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    tally = rk.tally_at_k(judged, rk.gold_counts(every, gold, keys), max_k, keys=keys)
    return rk.precision_recall(tally, "hits").groupBy("kind", "k").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count("*").alias("n_cases"))


def _tagged(labels: Column, kind: str) -> Column:
    return F.transform(labels, lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("rnk"), x.alias("label")))


def _prompts(cases: DataFrame, evidence: DataFrame, k: int | None) -> DataFrame:
    lists = pm.evidence_lists(evidence, k)
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    return cases.join(lists, "case_id", "left").withColumn("prompt", pm.ranked_prompt(F.col("context"), pm.numbered_block(texts)))


def fused_prompts(cases: DataFrame, parts: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Prompts with the evidence found for the parts of each case. Texts join last."""
    hits = rt.fused_search(docs, parts, k)
    return _prompts(cases, rt.with_texts(hits, docs).select("case_id", "rnk", "text"), k)


def prompt_table(notes: DataFrame, evidence: DataFrame, conditions: tuple[str, ...] = ("baseline", "rag", "tuned"), k: int | None = None) -> DataFrame:
    """Prompts of every case under every condition: cleaned context, and evidence unless baseline."""
    cleaned = notes.select("case_id", tx.clean_note(F.col("context")).alias("context"))
    with_evidence = _prompts(cleaned, evidence, k)
    both = with_evidence.withColumn("bare", pm.ranked_prompt(F.col("context")))
    rows = both.withColumn("cond", F.explode(F.array(*[F.lit(c) for c in conditions])))
    return rows.select("case_id", "cond", F.when(F.col("cond") == "baseline", F.col("bare")).otherwise(F.col("prompt")).alias("prompt"))


def alignment_run(docs: DataFrame, questions: DataFrame, answers: DataFrame, verdicts: DataFrame, k: int = 5) -> DataFrame:
    """Retrieve for the question, align the answer with what was found, count it if correct."""
    hits = lx.search(docs, questions, k)
    best = rt.align(docs, answers, hits.select("query_id", "doc_id")).filter("rnk = 1").withColumnRenamed("score", "alignment")
    return best.join(verdicts, "query_id").withColumn("reward", gr.gated_alignment(F.col("alignment"), F.col("correct")))


def mcq_run(outputs: DataFrame, second: DataFrame, gold: DataFrame) -> DataFrame:
    """Parse MCQ outputs, rescue failed ones from a second extraction, and count the answers."""
    first = outputs.select("case_id", rp.mcq_answer(tx.strip_thinking(F.col("raw_output")))["answer"].alias("answer"))
    other = second.select("case_id", rp.mcq_answer(F.col("raw_output"))["answer"].alias("rescued"))
    merged = first.join(other, "case_id", "left").withColumn("answer", F.coalesce("answer", "rescued"))
    return cm.answer_distribution(ex.match_records(merged.select("case_id", "answer"), gold))


def metrics_run(predictions: DataFrame, gold: DataFrame, nli: DataFrame, cases: DataFrame, max_k: int = 5) -> DataFrame:
    """Accuracy and grounding of all predictions, merged, per case at k, averaged."""
    judged = rk.label_verdicts(predictions, gold)
    grounded = gr.attach(predictions, gr.sentence_level(nli))
    rewards = gr.reward_rows(grounded, judged)
    tally = rk.tally_at_k(judged, rk.gold_counts(cases, gold), max_k)
    return cm.mean_metrics(cm.metric_rows(tally, rewards, cases, max_k))


def report_run(judged: DataFrame, row_id: Column, k: int = 5, threshold: float = 0.5, replicates: int = 1000) -> DataFrame:
    """Taxonomy, score distribution and the interval of the mean score per model and condition."""
    by = ("model", "cond")
    spread = cm.distribution(judged, "g_max", threshold, by)
    interval = st.bootstrap_ci(judged, "g_max", row_id, by, replicates).select(*by, "lower", "upper")
    return co.taxonomy(judged, k, "g_max", threshold, by).join(spread, list(by)).join(interval, list(by))
