"""Plug-in scorers over Arrow batches: embedder, pair scorer, judge; and a lexical stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import tokens


def _batched(df: DataFrame, load: Callable[[], Callable], columns: list[str], schema: str,
             apply: Callable[[Callable, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            if len(batch):
                model = load() if model is None else model  # once per task
                yield apply(model, batch)
    return df.select(*columns).mapInPandas(run, schema)


def _digest(df: DataFrame, *columns: str) -> Column:
    """128 bits over the columns; rows with a null among them get keys that spread and meet nothing."""
    whole = F.md5(F.concat(*[part for c in columns for part in (F.octet_length(c).cast("string"), F.lit(":"), F.col(c))]))
    return F.coalesce(whole, F.concat(F.lit("null:"), F.xxhash64(*df.columns).cast("string")))


def embed(texts: DataFrame, load: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """(text, vector) for the distinct texts; ``load`` returns a function from texts to vectors."""
    return _batched(texts.select("text").distinct(), load, ["text"], "text string, vector array<double>",
                    lambda f, b: pd.DataFrame({"text": b["text"], "vector": [[float(x) for x in v] for v in f(list(b["text"]))]}))


def score_pairs(pairs: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list]]) -> DataFrame:
    """Adds entailment, neutral, contradiction. Each distinct (premise, sentence) is scored once; rows without
    either keep null scores. Rows meet their scores by a digest, so texts are shuffled once and are no keys."""
    def apply(f, batch):
        scores = f(list(zip(batch["premise"], batch["sentence"])))
        out = batch.copy()
        for i, c in enumerate(("entailment", "neutral", "contradiction")):
            out[c] = [float(s[i]) for s in scores]
        return out
    keyed = pairs.withColumn("_key", _digest(pairs, "premise", "sentence"))
    distinct = keyed.filter("premise is not null and sentence is not null").select("_key", "premise", "sentence").dropDuplicates(["_key"])
    scored = _batched(distinct, load, ["_key", "premise", "sentence"],
                      "_key string, premise string, sentence string, entailment double, neutral double, contradiction double", apply)
    return keyed.join(scored.drop("premise", "sentence"), "_key", "left").drop("_key")


def judge(tasks: DataFrame, load: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """Adds ``is_correct``. Rows without a prompt are false and never reach the judge; a batch the
    judge fails on is false throughout."""
    def apply(f, batch):
        try:
            said = [bool(x) for x in f(list(batch["prompt"]))]
        except Exception:
            said = [False] * len(batch)
        return pd.DataFrame({"_key": batch["_key"], "is_correct": said})
    keyed = tasks.withColumn("_key", _digest(tasks, "prompt"))
    asked = keyed.filter(F.col("prompt").isNotNull()).select("_key", "prompt").dropDuplicates(["_key"])
    verdicts = _batched(asked, load, ["_key", "prompt"], "_key string, is_correct boolean", apply)
    return keyed.join(verdicts, "_key", "left").drop("_key").fillna(False, ["is_correct"])


def lexical_overlap(premise: Column, sentence: Column) -> Column:
    """Share of the sentence's distinct tokens that the premise has. Not an entailment score."""
    s = F.array_distinct(tokens(sentence))
    return F.when(F.size(s) > 0, F.size(F.array_intersect(s, tokens(premise))) / F.size(s)).otherwise(F.lit(0.0))
