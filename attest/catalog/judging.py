"""Calibration, agreement, review queue (MET-07/08, FIL-07, SNK-05/07, UDF-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import filters as fl, judging as jd
from .registry import query
from .shared import r6

EDGES = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(jd.EDGES, jd.EDGES[1:])))
BIN_VIEWS = {"v_bins": f"SELECT * FROM (VALUES {EDGES}) t(bin, lower, upper)",
             "v_binned": """SELECT j.*, bin FROM v_judgements j LEFT JOIN v_bins ON (confidence >= lower AND confidence < upper)
                OR (bin = 9 AND confidence = 1.0::DOUBLE)""",
             "v_curve": """SELECT b.bin, count(j.judgement_id) AS n, avg(gold::INT) AS accuracy, avg(confidence) AS confidence
                FROM v_bins b LEFT JOIN v_binned j ON b.bin = j.bin GROUP BY 1"""}


@query("met_07", """SELECT bin, n, round(accuracy, 6) + 0.0 AS accuracy, round(confidence, 6) + 0.0 AS confidence,
    round((SELECT sum(n::DOUBLE / (SELECT count(*) FROM v_judgements) * abs(accuracy - confidence)) FROM v_curve), 6) + 0.0 AS ece,
    round((SELECT max(abs(accuracy - confidence)) FROM v_curve), 6) + 0.0 AS mce FROM v_curve""", BIN_VIEWS)
def met_07(spark, sf):
    judgements = fx.judgements(spark, sf)
    whole = jd.calibration(judgements).select("ece", "mce")
    return jd.calibration_curve(judgements).join(F.broadcast(whole), F.lit(True)).select(
        "bin", "n", r6("accuracy"), r6("confidence"), r6("ece"), r6("mce"))


@query("met_08", """SELECT round(po, 6) + 0.0 AS accuracy, round((po - pe) / (1 - pe), 6) + 0.0 AS kappa, round(tp / (tp + fp), 6) + 0.0 AS precision,
    round(tp / (tp + fn), 6) + 0.0 AS recall, round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1 FROM (SELECT *, (tp + tn) / n AS po,
    ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM (SELECT count(*)::DOUBLE AS n,
    count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END)::DOUBLE AS tp, count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END)::DOUBLE AS fp,
    count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END)::DOUBLE AS fn, count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END)::DOUBLE AS tn FROM labels))""")
def met_08(spark, sf):
    rows = fx.table(spark, sf, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return jd.agreement(rows, "a", "b").select(*[r6(c) for c in ("accuracy", "kappa", "precision", "recall", "f1")])


@query("fil_07", "SELECT judgement_id, confidence FROM v_judgements WHERE confidence < 0.6::DOUBLE ORDER BY confidence, judgement_id LIMIT 50")
def fil_07(spark, sf):
    return fl.low_confidence(fx.judgements(spark, sf), 50).select("judgement_id", "confidence")


@query("snk_05", """SELECT judgement_id, verdict::VARCHAR AS label, gold, verdict, confidence, NULL::BOOLEAN AS is_correct, '' AS notes FROM v_judgements""")
def snk_05(spark, sf):
    from ..session import scratch_path
    from ..sources.writers import annotation_queue
    path = scratch_path(spark, "annotation")
    queue = annotation_queue(fx.judgements(spark, sf).withColumn("label", F.col("verdict").cast("string")))
    queue.write.json(path, ignoreNullFields=False)
    return spark.read.schema(queue.schema).json(path)
