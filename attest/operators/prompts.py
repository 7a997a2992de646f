"""Prompt tables. The wording is user configuration; these defaults are short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_evidence

NO_EVIDENCE = "No documents provided."


def numbered_block(texts: Column, head: str = "Evidence {i}:\n", empty: str = NO_EVIDENCE) -> Column:
    """Texts under numbered heads, a blank line between them; a fixed sentence when there are none."""
    before, after = head.split("{i}")
    items = F.transform(texts, lambda t, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after), t))
    return F.when(F.size(texts) > 0, F.array_join(items, "\n\n")).otherwise(F.lit(empty))


def evidence_lists(evidence: DataFrame, k: int | None = None) -> DataFrame:
    """The evidence texts of each case, cleaned and in rank order: all that was retrieved, or the first k. Rows beyond
    k never reach the list."""
    kept = evidence if k is None else evidence.filter(F.col("rnk") <= k)
    lists = kept.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rnk", clean_evidence(F.col("text")).alias("text")))).alias("e"))
    return lists.select("case_id", F.transform("e", lambda x: x["text"]).alias("texts"))


def ranked_prompt(context: Column, block: Column | None = None, n: int = 5) -> Column:
    parts = [F.lit(f"List the {n} most likely diagnoses as JSON with name and reasoning.\n\nPatient:\n"), context]
    if block is not None:
        parts += [F.lit("\n\nRetrieved evidence:\n"), block]
    return F.concat(*parts, F.lit("\n\nIMPORTANT: answer with JSON only."))


def mcq_prompt(question: Column, block: Column | None = None) -> Column:
    parts = [F.lit("Choose the best answer and explain it as JSON.\n\nQuestion:\n"), question]
    if block is not None:
        parts += [F.lit("\n\nRetrieved authorities:\n"), block]
    return F.concat(*parts, F.lit("\n\nCRITICAL: answer with JSON only."))


def judge_prompt(candidate: Column, truths: Column) -> Column:
    """One prompt per prediction: does it match any of the accepted labels?"""
    return F.concat(F.lit('Candidate: "'), candidate, F.lit('"\nAccepted:\n'), truths,
                    F.lit("\nDoes the candidate mean the same as any accepted label? TRUE or FALSE.\nVerdict:"))


def judge_tasks(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """One judge prompt per prediction of a case that has gold labels."""
    truths = gold.groupBy("case_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_set("label")), lambda g: F.concat(F.lit("- "), g)), "\n").alias("truths"))
    return predictions.join(truths, "case_id").withColumn("prompt", judge_prompt(F.col("label"), F.col("truths"))).drop("truths")


def pair_tasks(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """One judge prompt per (prediction, gold label) of a case. The pairs are the result."""
    pairs = predictions.join(gold.select("case_id", F.col("label").alias("gold_label")), "case_id")
    return pairs.withColumn("prompt", judge_prompt(F.col("label"), F.concat(F.lit("- "), "gold_label")))


def confidence_tag(confidence: Column, needs_evidence: Column) -> Column:
    """Tag of a prediction in the refinement prompt; ``assessed`` when there is no critique."""
    return (F.when(needs_evidence, "LOW confidence - evidence retrieved")
            .when(confidence.isNotNull(), F.concat(confidence, F.lit(" confidence"))).otherwise("assessed"))
