"""Premises, pairs, and the joins around scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..functions.text import strip
from ..functions.vectors import dot, norm
from ..session import materialised

JUDGED = ["case_id", "rnk"]


def prediction_gold_pairs(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Every (prediction, gold label) of a case: the rows a judge scores, so each pair is wanted."""
    return predictions.join(gold.select("case_id", F.col("label").alias("gold_label")), "case_id")


def premise_rows(sections: DataFrame, evidence: DataFrame, anchors: tuple[str, ...]) -> DataFrame:
    """Premises per case: anchor + each other section, then anchor + each non-blank evidence text;
    the anchor alone for a case with neither; none if that is blank too.

    ``sections`` holds case_id and the array ``sections`` of a case, read once and used by all of
    its predictions; ``evidence`` holds case_id, rnk, text."""
    base = sections.select("case_id", tx.anchor_text(F.col("sections"), anchors).alias("anchor"),
                           tx.other_sections(F.col("sections"), anchors).alias("others"))
    own = base.select("case_id", "anchor", F.posexplode("others").alias("idx", "part"), F.lit(0).alias("source"))
    found = evidence.filter(F.trim("text") != "").select("case_id", F.col("rnk").alias("idx"), F.col("text").alias("part"))
    found = found.join(base.select("case_id", "anchor"), "case_id").select(
        "case_id", "anchor", "idx", "part", F.lit(1).alias("source"))
    both = own.unionByName(found)
    alone = base.filter((F.size("others") == 0) & (F.trim("anchor") != "")).join(
        evidence.filter(F.trim("text") != "").select("case_id").distinct(), "case_id", "left_anti").select(
        "case_id", "anchor", F.lit(0).alias("idx"), F.lit("").alias("part"), F.lit(2).alias("source"))
    return both.unionByName(alone).select(
        "case_id", "source", "idx", tx.strip(F.concat_ws("\n", F.when(F.col("anchor") != "", F.col("anchor")),
                                                         F.when(F.col("part") != "", F.col("part")))).alias("premise"))


def mcq_premise_rows(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """Question + each passage, plus the gold passage unless it is among them; else the question.

    ``questions`` holds case_id, anchor, gold_passage; ``passages`` case_id, idx, text."""
    kept = passages.filter(F.trim("text") != "").select("case_id", "idx", F.trim("text").alias("part"))
    gold = questions.filter(F.trim(F.coalesce("gold_passage", F.lit(""))) != "").select(
        "case_id", F.lit(-1).alias("idx"), F.trim("gold_passage").alias("part"))
    missing = gold.join(kept.select("case_id", "part"), ["case_id", "part"], "left_anti").select("case_id", "idx", "part")
    parts = kept.unionByName(missing)
    joined = parts.join(questions.select("case_id", "anchor"), "case_id")
    alone = questions.select("case_id", "anchor").join(parts.select("case_id").distinct(), "case_id", "left_anti")
    return joined.select("case_id", "idx", F.concat("anchor", F.lit("\n\n"), "part").alias("premise")).unionByName(
        alone.select("case_id", F.lit(0).alias("idx"), F.col("anchor").alias("premise")))


def premise_sentence_pairs(premises: DataFrame, reasoning: DataFrame, split=tx.sentences) -> DataFrame:
    """Every (premise, reasoning sentence) of a prediction. Texts stay in their own tables: the
    pair rows carry keys, and ``scoring.score_pairs`` scores each distinct text pair once."""
    sentences = reasoning.select(*JUDGED, F.posexplode(split(F.col("reasoning"))).alias("sentence_idx", "sentence"))
    return sentences.join(premises, "case_id")


EVIDENCE = ("none", "gold", "retrieved", "retrieved + gold")


def with_gold_passage(evidence: DataFrame, gold: DataFrame) -> DataFrame:
    """Put the gold passage before the evidence of a case unless its text is already there. Blank evidence goes, and
    ranks close up."""
    first = gold.select("case_id", strip(F.col("text")).alias("text")).filter("text <> ''")
    have = evidence.select("case_id", "rnk", strip(F.col("text")).alias("text")).filter("text <> ''")
    missing = first.join(have, ["case_id", "text"], "left_anti").select("case_id", F.lit(0).alias("rnk"), "text")
    order = W.partitionBy("case_id").orderBy("rnk")
    return have.unionByName(missing).withColumn("rnk", F.row_number().over(order)).select("case_id", "rnk", "text")


def chosen_evidence(evidence: DataFrame, gold: DataFrame, choice: str) -> DataFrame:
    """The evidence of a run: none, the gold passage alone, what was retrieved, or both."""
    if choice not in EVIDENCE:
        raise ValueError(f"choice must be one of {EVIDENCE}")
    retrieved = evidence if "retrieved" in choice else evidence.filter(F.lit(False))
    return with_gold_passage(retrieved, gold if "gold" in choice else gold.filter(F.lit(False)))


def exact_match_at_k(predictions: DataFrame, gold: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """String-equality precision and recall of the first k labels."""
    from . import ranking as rk
    tally = rk.tally_at_k(rk.label_verdicts(predictions, gold), rk.gold_counts(cases, gold), k)
    return rk.precision_recall(tally, "hits").filter(F.col("k") == k)


def letter_accuracy(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """1.0 where the answer letter equals the gold letter, ignoring case and spaces."""
    same = F.upper(F.trim("answer")) == F.upper(F.trim("gold_answer"))
    return gold.join(answers, "case_id", "left").withColumn(
        "accuracy", F.when(F.coalesce(same, F.lit(False)), 1.0).otherwise(0.0))


def embedding_match(predictions: DataFrame, gold: DataFrame, vectors: DataFrame, k: int = 3,
                    threshold: float = 0.80, epsilon: float = 1e-8) -> DataFrame:
    """Share of the first k predictions whose best gold similarity reaches the threshold.

    Similarities are taken once per distinct label pair that meets in a case, not per row."""
    top = predictions.filter(F.col("rnk") <= k).select("case_id", "rnk", "label")
    truth = gold.select("case_id", F.col("label").alias("gold_label")).distinct()
    met = top.join(truth, "case_id")
    distinct = met.select("label", "gold_label").distinct()
    va = vectors.select("label", F.col("vector").alias("va"))
    vb = vectors.select(F.col("label").alias("gold_label"), F.col("vector").alias("vb"))
    sims = distinct.join(va, "label").join(vb, "gold_label").select(
        "label", "gold_label", (dot(F.col("va"), F.col("vb")) / (norm(F.col("va")) * norm(F.col("vb")) + epsilon)).alias("sim"))
    best = met.join(sims, ["label", "gold_label"]).groupBy(*JUDGED).agg(F.max("sim").alias("best"))
    scored = top.join(best, JUDGED, "left").withColumn("hit", (F.coalesce("best", F.lit(-1.0)) >= threshold).cast("double"))
    return scored.groupBy("case_id").agg(F.avg("hit").alias("accuracy"), F.count("*").alias("n"))


def match_critiques(predictions: DataFrame, critiques: DataFrame) -> DataFrame:
    """The critique of each prediction: by position, else by lower-cased label, the last one of
    that label; nulls where there is none."""
    fields = ["confidence", "needs_evidence"]
    # Read by two joins, and critiques may be costly to parse.
    critiques = materialised(critiques.select("case_id", "critique_idx", "label", *fields), "critiques")
    by_index = critiques.select("case_id", (F.col("critique_idx") + 1).alias("rnk"), F.lit(True).alias("has"), *fields)
    named = critiques.filter(F.col("label") != "").groupBy("case_id", F.lower("label").alias("key")).agg(
        F.max_by(F.struct(*fields), "critique_idx").alias("named"))
    rows = predictions.join(by_index, JUDGED, "left").withColumn("key", F.lower("label")).join(named, ["case_id", "key"], "left")
    pick = [F.when(F.col("has"), F.col(f)).otherwise(F.col(f"named.{f}")).alias(f) for f in fields]
    return rows.select(*predictions.columns, *pick)


def merge_by_case(rows: DataFrame, grounding: DataFrame) -> DataFrame:
    """Attach grounding by case; null where a case has none."""
    return rows.join(grounding, "case_id", "left")


def aligned_metrics(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Cases that have a value in every one of the given runs, a column per run."""
    wide = runs.filter(F.col("run").isin(columns)).groupBy("case_id").agg(
        *[F.max(F.when(F.col("run") == c, F.col("value"))).alias(c) for c in columns])
    return wide.dropna(subset=columns)


def mentioned_labels(evidence: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Gold labels that occur, in whatever case, in a piece of their own case's evidence: (keys, label), each once.

    Labels are distinct per case before they meet the evidence, and a label leaves a task once per case."""
    labels = gold.select(*keys, "label").filter(F.col("label") != "").distinct()
    found = evidence.select(*keys, F.lower("text").alias("_low")).join(labels, list(keys)).filter(F.contains("_low", F.lower("label")))
    return found.select(*keys, "label").distinct()
