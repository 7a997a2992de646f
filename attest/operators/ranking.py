"""Metrics at k over ranked predictions.

The sums at k are such as a partial aggregate can take before the shuffle: no per-case window and no
per-case list, so a case that holds a large share of the rows costs no more than its share.
Column names: ``case_id, rnk`` (from 1), ``label``; results are long, ``case_id, k, value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RECALLS = ("covered", "capped", "hits")


def _per_k(wide: DataFrame, keys: list[str], max_k: int, columns: dict) -> DataFrame:
    """Turn wide per-case counts into one row per k; ``columns`` maps a name to k -> Column."""
    rows = F.array(*[
        F.struct(F.lit(k).alias("k"), *[make(k).alias(name) for name, make in columns.items()])
        for k in range(1, max_k + 1)])
    return wide.select(*keys, F.inline(rows))


def reward_at_k(scores: DataFrame, cases: DataFrame, value: str = "reward", max_k: int = 5,
                key: str = "case_id") -> DataFrame:
    """Mean of the first min(k, n) values in rank order, 0 for a case without predictions."""
    if max_k < 1:
        raise ValueError("max_k must be positive")
    empty = cases.select(key, F.lit(None).cast("int").alias("rnk"), F.lit(None).cast("double").alias(value))
    wide = scores.select(key, "rnk", F.col(value).cast("double").alias(value)).unionByName(empty).groupBy(key).agg(
        *[F.avg(F.when(F.col("rnk") <= k, F.col(value))).alias(f"m{k}") for k in range(1, max_k + 1)])
    return _per_k(wide, [key], max_k, {"value": lambda k: F.coalesce(F.col(f"m{k}"), F.lit(0.0))})


def label_verdicts(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with ``matched``: the lower-cased label is among the case's gold labels."""
    truth = gold.select("case_id", F.lower("label").alias("gold_key"), F.lit(True).alias("matched")).distinct()
    return (
        predictions.withColumn("gold_key", F.lower("label"))
        .join(truth, ["case_id", "gold_key"], "left").drop("gold_key")
        .withColumn("matched", F.coalesce("matched", F.lit(False)))
    )


def tally_at_k(judged: DataFrame, gold_counts: DataFrame, max_k: int = 5,
               matches: DataFrame | None = None, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Per case and k: predictions kept, hits, distinct gold labels covered, gold labels.

    ``judged`` holds ``rnk, matched`` and, unless ``matches`` gives the true (rnk, gold_label)
    pairs, ``label`` as the gold label a match covers. ``gold_counts`` holds ``n_gold`` and
    lists every case to report, 0 included.
    """
    keys = list(keys)
    span = range(1, max_k + 1)
    if matches is None:
        wide = _tally_by_label(judged, gold_counts, keys, span)
    else:
        wide = _tally_by_match(judged, gold_counts, keys, span, matches)
    return _per_k(wide, [*keys, "n_gold"], max_k, {
        "n_pred": lambda k: F.col(f"n{k}"), "hits": lambda k: F.col(f"h{k}"), "covered": lambda k: F.col(f"c{k}")})


def _tally_by_label(judged: DataFrame, gold_counts: DataFrame, keys: list[str], span: range) -> DataFrame:
    """One pass over the predictions: counts and first match per (case, label), then per case."""
    rnk, hit = F.col("rnk"), F.col("matched")
    per_label = judged.groupBy(*keys, F.lower("label").alias("gold_label")).agg(
        F.min(F.when(hit, rnk)).alias("first_rank"),
        *[F.count(F.when(rnk <= k, 1)).alias(f"n{k}") for k in span],
        *[F.count(F.when((rnk <= k) & hit, 1)).alias(f"h{k}") for k in span])
    zero = F.lit(0).cast("bigint")
    counts = [f"{c}{k}" for c in "nhc" for k in span]
    rows = per_label.select(
        *keys, zero.alias("n_gold"), *[f"n{k}" for k in span], *[f"h{k}" for k in span],
        *[F.coalesce((F.col("first_rank") <= k).cast("bigint"), zero).alias(f"c{k}") for k in span])
    gold = gold_counts.select(*keys, F.col("n_gold").cast("bigint"), *[zero.alias(c) for c in counts])
    return rows.unionByName(gold).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_gold", *counts)])


def _tally_by_match(judged: DataFrame, gold_counts: DataFrame, keys: list[str], span: range,
                    matches: DataFrame) -> DataFrame:
    blank = F.lit(0).cast("bigint")
    first = matches.groupBy(*keys, "gold_label").agg(F.min("rnk").alias("first_rank"))
    parts = [
        judged.select(*keys, "rnk", F.col("matched").cast("int").alias("hit"),
                      F.lit(None).cast("int").alias("first_rank"), blank.alias("n_gold")),
        first.select(*keys, F.lit(None).cast("int").alias("rnk"), F.lit(0).alias("hit"),
                     "first_rank", blank.alias("n_gold")),
        gold_counts.select(*keys, F.lit(None).cast("int").alias("rnk"), F.lit(0).alias("hit"),
                           F.lit(None).cast("int").alias("first_rank"), F.col("n_gold").cast("bigint")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy(*keys).agg(
        F.sum("n_gold").alias("n_gold"),
        *[F.count(F.when(F.col("rnk") <= k, 1)).alias(f"n{k}") for k in span],
        *[F.count(F.when((F.col("rnk") <= k) & (F.col("hit") == 1), 1)).alias(f"h{k}") for k in span],
        *[F.count(F.when(F.col("first_rank") <= k, 1)).alias(f"c{k}") for k in span])


def gold_counts(cases: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Distinct gold labels per case, 0 for a case without any."""
    keys = list(keys)
    rows = gold.select(*keys, F.lower("label").alias("label")).distinct().select(*keys, F.lit(1).alias("one"))
    return rows.unionByName(cases.select(*keys, F.lit(0).alias("one"))).groupBy(*keys).agg(
        F.sum("one").alias("n_gold"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def precision_recall(tally: DataFrame, recall: str = "covered") -> DataFrame:
    """Precision, recall and F1 from a tally. All 0 without predictions or without gold.

    ``covered``: distinct gold labels found; ``capped``: hits up to the gold count; ``hits``: all
    hits, which may exceed 1 when several predictions match one gold label.
    """
    if recall not in RECALLS:
        raise ValueError(f"recall must be one of {RECALLS}")
    top = {"covered": F.col("covered"), "capped": F.least("hits", "n_gold"), "hits": F.col("hits")}[recall]
    usable = (F.col("n_pred") > 0) & (F.col("n_gold") > 0)
    keys = [c for c in tally.columns if c not in ("n_pred", "hits", "covered", "n_gold")]
    return tally.select(
        *keys,
        F.when(usable, F.col("hits") / F.col("n_pred")).otherwise(0.0).alias("precision"),
        F.when(usable, top / F.col("n_gold")).otherwise(0.0).alias("recall"),
    ).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def coverage_curve(judged: DataFrame, width: int = 64) -> DataFrame:
    """One row per prediction: hits and distinct gold labels covered up to its rank.

    Running counts in two levels: ranks fall into bands of ``width``, a window runs inside a band, and the bands'
    totals run per case, so the list of one case is shared among tasks. A label counts where it first matches."""
    first = judged.filter("matched").groupBy("case_id", "label").agg(F.min("rnk").alias("first_rnk"))
    rows = judged.join(first, ["case_id", "label"], "left").withColumn("band", F.expr(f"(rnk - 1) div {width}")).withColumns({
        "hit": F.col("matched").cast("long"), "new": (F.col("matched") & (F.col("rnk") == F.col("first_rnk"))).cast("long")})
    inside = W.partitionBy("case_id", "band").orderBy("rnk")
    before = W.partitionBy("case_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    bands = rows.groupBy("case_id", "band").agg(F.sum("hit").alias("h"), F.sum("new").alias("c")).select(
        "case_id", "band", F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"))
    return rows.withColumns({"hits": F.sum("hit").over(inside), "covered": F.sum("new").over(inside)}).join(bands, ["case_id", "band"]).select(
        "case_id", "rnk", "label", "matched", (F.col("hits") + F.col("h")).alias("hits"), (F.col("covered") + F.col("c")).alias("covered"))


def label_counts(predictions: DataFrame, gold: DataFrame, cases: DataFrame,
                 classes: DataFrame | None = None) -> DataFrame:
    """Per label TP/FP/FN/TN over cases as sets, with precision, recall, F1 and support.

    Classes are the gold labels unless a frame of ``label`` is given."""
    pred = predictions.select("case_id", "label").distinct().withColumn("p", F.lit(1))
    true = gold.select("case_id", "label").distinct().withColumn("g", F.lit(1))
    both = pred.join(true, ["case_id", "label"], "full_outer")
    counts = both.groupBy("label").agg(
        F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("g").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    if classes is None:
        counts = counts.filter(F.col("tp") + F.col("fn") > 0)
    else:
        counts = classes.select("label").distinct().join(counts, "label", "left").fillna(0, ["tp", "fp", "fn"])
    total = cases.select("case_id").distinct().agg(F.count("*").alias("n_cases"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    # One row, so the product keeps the row count.
    return (
        counts.join(F.broadcast(total), F.lit(True))
        .withColumn("tn", F.col("n_cases") - tp - fp - fn)
        .withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0))
        .withColumn("recall", F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0))
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
        .withColumn("support", tp + fn).drop("n_cases")
    )


def macro_micro(counts: DataFrame) -> DataFrame:
    summed = counts.agg(F.avg("f1").alias("macro_f1"), F.sum("tp").alias("tp"),
                        F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        summed.withColumn("micro_precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0))
        .withColumn("micro_recall", F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0))
        .withColumn("micro_f1", f1(F.col("micro_precision"), F.col("micro_recall")))
    )


def retrieval_tally(retrieved: DataFrame, relevant: DataFrame, queries: DataFrame, max_k: int) -> DataFrame:
    """Per query and k: distinct documents retrieved, distinct relevant ones among them, and all
    relevant documents. ``retrieved`` holds ``query_id, rnk, doc_id``."""
    truth = relevant.select("query_id", "doc_id").distinct()
    first = retrieved.groupBy("query_id", "doc_id").agg(F.min("rnk").alias("first_rank"))
    marked = first.join(truth.withColumn("relevant", F.lit(1)), ["query_id", "doc_id"], "full_outer")
    rows = marked.select("query_id", "first_rank", "relevant").unionByName(queries.select(
        "query_id", F.lit(None).cast("int").alias("first_rank"), F.lit(None).cast("int").alias("relevant")))
    hit = F.col("relevant") == 1
    span = range(1, max_k + 1)
    return rows.groupBy("query_id").agg(
        F.count("relevant").alias("n_relevant"),
        F.min(F.when(hit, F.col("first_rank"))).alias("first_hit"),
        *[F.count(F.when(F.col("first_rank") <= k, 1)).alias(f"n{k}") for k in span],
        *[F.count(F.when((F.col("first_rank") <= k) & hit, 1)).alias(f"h{k}") for k in span])


def retrieval_metrics(retrieved: DataFrame, relevant: DataFrame, queries: DataFrame, max_k: int = 5) -> DataFrame:
    """Success, precision (over distinct retrieved) and recall at k, averaged over queries."""
    tally = retrieval_tally(retrieved, relevant, queries, max_k)
    rows = _per_k(tally, ["n_relevant"], max_k, {"n": lambda k: F.col(f"n{k}"), "h": lambda k: F.col(f"h{k}")})
    n, h = F.col("n"), F.col("h")
    return rows.groupBy("k").agg(
        F.avg((h > 0).cast("double")).alias("success"),
        F.avg(F.when(n > 0, h / n).otherwise(0.0)).alias("precision"),
        F.avg(F.when(F.col("n_relevant") > 0, h / F.col("n_relevant")).otherwise(0.0)).alias("recall"))


def mean_reciprocal_rank(retrieved: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    tally = retrieval_tally(retrieved, relevant, queries, 1)
    return tally.agg(F.avg(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))).alias("mrr"),
                     F.count("*").alias("n_queries"))


def ndcg_at_k(scores: DataFrame, value: str, max_k: int = 5, key: str = "case_id") -> DataFrame:
    """NDCG@k per case: log2 discount, ideal = the same top k in descending order."""
    kept = scores.filter(F.col("rnk") <= max_k)
    # At most max_k values per case reach the list, since ranks are unique within a case.
    ranked = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rnk", F.col(value).alias("v")))).alias("top"))
    values = F.transform("top", lambda x: x["v"])

    def gain(array):
        discounted = F.transform(array, lambda v, i: v / F.log2(i + F.lit(2)))
        return F.aggregate(discounted, F.lit(0.0), lambda acc, v: acc + v)

    per_k = []
    for k in range(1, max_k + 1):
        head = F.slice(values, 1, k)
        ideal = gain(F.sort_array(head, asc=False))
        per_k.append(F.struct(F.lit(k).alias("k"), F.when(ideal > 0, gain(head) / ideal).otherwise(0.0).alias("ndcg")))
    return ranked.select(key, F.inline(F.array(*per_k)))


def confusion(predictions: DataFrame, gold: DataFrame, top: DataFrame) -> DataFrame:
    """Gold x predicted label counts over the labels in ``top``; duplicates count.

    Both sides are counted per case and label before the join, so a case yields at most
    |top| x |top| pairs however many rows it has."""
    labels = top.select("label")
    p = predictions.join(labels, "label", "left_semi").groupBy("case_id", F.col("label").alias("pred")).agg(
        F.count("*").alias("np"))
    g = gold.join(labels, "label", "left_semi").groupBy("case_id", F.col("label").alias("gold")).agg(
        F.count("*").alias("ng"))
    return p.join(g, "case_id").groupBy("gold", "pred").agg(F.sum(F.col("np") * F.col("ng")).alias("n"))


def top_labels(gold: DataFrame, n: int) -> DataFrame:
    return gold.groupBy("label").count().orderBy(F.desc("count"), "label").limit(n)
