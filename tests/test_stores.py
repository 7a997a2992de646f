"""Exports as a whole, scores kept across runs, and the tracker of attempts."""

import os

import pytest
from pyspark.sql import functions as F

from attest import fixtures as fx
from attest.catalog.extraction import failures
from attest.operators import extraction as ex, scorestore as ss, scoring, training as tr
from attest.sources import exports as ep, writers as wr
from attest.streaming import monitors as mo, tracker as tk

SF = "/root/testdata/sf0.001"


def test_an_export_is_whole_or_not_there(spark, tmp_path):
    path = f"{tmp_path}/out"
    one, two = spark.range(3), spark.range(5).withColumn("x", F.lit("a"))
    assert ep.manifest(path) is None
    with pytest.raises(FileNotFoundError):
        ep.read_export(spark, path, "one")
    # The second table fails after the first is written.
    broken = spark.range(1).select(F.raise_error(F.lit("stop")).cast("string").alias("x"))
    with pytest.raises(Exception):
        ep.write_export({"one": (one, "json"), "two": (broken, "parquet")}, path)
    assert os.listdir(path) and ep.manifest(path) is None
    ep.write_export({"one": (one, "json"), "two": (two, "parquet")}, path)
    assert (ep.read_export(spark, path, "one").count(), ep.read_export(spark, path, "two").count()) == (3, 5)
    with pytest.raises(Exception):
        ep.write_export({"one": (two, "json"), "two": (broken, "parquet")}, path)
    assert ep.read_export(spark, path, "one").count() == 3
    ep.write_export({"one": (spark.range(7), "json"), "two": (two, "parquet")}, path)
    assert ep.read_export(spark, path, "one").count() == 7
    # Two stopped runs and the first whole one, two folders each.
    assert ep.drop_replaced(path) == 6
    assert (ep.read_export(spark, path, "one").count(), ep.drop_replaced(path)) == (7, 0)


def test_results_and_metrics_are_exports(spark, tmp_path):
    wr.write_results(spark.range(2), spark.range(1), {"mode": "x", "k": "5"}, f"{tmp_path}/r")
    assert {r.key: r.value for r in ep.read_export(spark, f"{tmp_path}/r", "config").collect()} == {"mode": "x", "k": "5"}
    wr.write_metrics(spark.range(1), spark.range(4), f"{tmp_path}/m")
    assert ep.read_export(spark, f"{tmp_path}/m", "per_case").count() == 4


def test_second_run_scores_new_pairs_alone(spark, tmp_path):
    calls = f"{tmp_path}/calls"
    os.makedirs(calls)

    def load():
        def score(pairs):
            import uuid
            with open(f"{calls}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(f"{p}/{s}" for p, s in pairs))
            return [(len(p) / 10, len(s) / 10, 0.0) for p, s in pairs]
        return score

    def called():
        out = sorted(x for f in os.listdir(calls) for x in open(f"{calls}/{f}").read().split("\n"))
        for f in os.listdir(calls):
            os.unlink(f"{calls}/{f}")
        return out
    schema = "id int, premise string, sentence string"
    first = spark.createDataFrame([(1, "ab", "c"), (2, "ab", "c"), (3, "a", "bc"), (4, None, "x"), (5, "", "")], schema)
    want = {r.id: (r.entailment, r.neutral) for r in scoring.score_pairs(first, lambda: lambda ps: [(len(p) / 10, len(s) / 10, 0.0) for p, s in ps]).collect()}
    out = ss.score_pairs(first, load, f"{tmp_path}/store", "run-1")
    assert {r.id: (r.entailment, r.neutral) for r in out.collect()} == want and out.count() == 5
    assert called() == ["/", "a/bc", "ab/c"]
    again = ss.score_pairs(first, load, f"{tmp_path}/store", "run-2")
    assert {r.id: (r.entailment, r.neutral) for r in again.collect()} == want
    assert called() == []
    more = first.unionByName(spark.createDataFrame([(6, "new", "one")], schema)).withColumn("pair_key", F.lit(1)).withColumn("neutral", F.lit(9.0))
    assert {r.id: r.entailment for r in ss.score_pairs(more, load, f"{tmp_path}/store", "run-1").collect()}[6] == 0.3
    assert called() == ["new/one"]
    assert ss.stored(spark, f"{tmp_path}/store").count() == 4
    ss.score_pairs(first, load, f"{tmp_path}/store", "run-3", scorer="another").count()
    assert len(called()) == 3
    assert ss.stored(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("expiry", [None, 400 * 86_400_000])
def test_tracker_equals_the_batch(spark, tmp_path, expiry):
    mo.replay(fx.attempts(spark, SF), f"{tmp_path}/in", lambda s: mo.run_available(tk.track(s, expiry_ms=expiry), str(tmp_path), "update"), parts=3)
    rows = {r.error_type: r for r in tk.tracked(mo.latest(spark, str(tmp_path), ["error_type", "spread"])).collect()}
    want = ex.error_examples(failures(spark, SF), 3).collect()
    assert {(t, e.attempt_id, e.preview) for t, r in rows.items() for e in r.examples} == {(w.error_type, w.attempt_id, w.preview) for w in want}
    counts = {r.error_type: r.n for r in fx.attempts(spark, SF).groupBy(mo.attempt_type().alias("error_type")).agg(F.count("*").alias("n")).collect()}
    assert {t: r.n for t, r in rows.items()} == counts and rows["success"].examples == []


def test_training_rows_hold_texts(spark):
    rows = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1), (2, "a", 0.5), (2, "b", 0.45), (3, "a", 1.0), (3, "b", 0.0)], "case_id int, item string, score double")
    prompts = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, None)], "case_id int, prompt string")
    said = spark.createDataFrame([(c, i, f"{i} says {c}") for c in (1, 2, 3) for i in "ab"], "case_id int, item string, response string")
    pairs = tr.with_texts(tr.preference_pairs(rows, ["case_id"]), prompts, said, ["case_id"], ["case_id"], ("chosen", "rejected"))
    assert [tuple(r) for r in pairs.select(*tr.PREFERENCE).collect()] == [("p1", "a says 1", "b says 1")]
    best = tr.with_texts(tr.supervised_rows(rows, ["case_id"]), prompts, said, ["case_id"], ["case_id"], ("item",))
    assert [tuple(r) for r in best.select(*tr.SUPERVISED, "score").collect()] == [("p1", "a says 1", 0.9)]
