"""Sources and sinks (SRC, SNK), each written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from .. import fixtures as fx
from ..operators import prompts as pm
from ..session import scratch_path
from ..sources import exports as ep, readers as rd, writers as wr
from . import shared as sh
from .registry import query
from .shared import VIEWS, r6



def corpus(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), "text",
                    F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))


@query("src_01", "SELECT p_partkey::VARCHAR AS p_partkey, p_name || chr(10) || 'x \"y\", z' AS p_name, CASE WHEN p_type = 'SMALL' THEN '' ELSE p_type END AS p_type FROM part")
def src_01(spark, sf):
    path = scratch_path(spark, "csv")
    rows = fx.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit(" \t "), "p_name", F.lit("\nx \"y\", z\t\n")).alias("p_name"), F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("p_type"))
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rd.read_csv(spark, path, ("p_partkey", "p_name", "p_type"))


@query("src_02", """SELECT c.case_id::VARCHAR AS case_id, subject_id::VARCHAR AS subject_id, sum((l_linestatus = 'F')::INT)::BIGINT AS n_diagnoses,
    sum((l_linestatus <> 'F')::INT)::BIGINT AS n_procedures FROM v_cases c JOIN lineitem ON l_orderkey = c.case_id WHERE l_returnflag <> 'N' GROUP BY 1, 2""")
def src_02(spark, sf):
    from .texts import case_labels
    notes, labels = scratch_path(spark, "notes"), scratch_path(spark, "labels")
    fx.cases(spark, sf).select("case_id", "subject_id").write.csv(notes, header=True)
    case_labels(spark, sf).write.csv(labels, header=True)
    n = rd.read_csv(spark, notes, ("case_id", "subject_id"))
    ls = rd.read_csv(spark, labels, ("case_id", "kind", "label", "position"))
    return rd.load_cases(n, ls).select("case_id", "subject_id", "n_diagnoses", "n_procedures")


@query("src_03", """SELECT c_custkey::VARCHAR AS idx, c_name || chr(10) || c_name AS question, c_mktsegment AS a, c_nationkey::VARCHAR AS b, '' AS d, 'A' AS answer FROM customer""")
def src_03(spark, sf):
    folder = scratch_path(spark, "qa")
    c = fx.table(spark, sf, "customer")
    blank = F.lit(None).cast("string")
    values = {"idx": F.col("c_custkey"), "question": F.concat("c_name", F.lit("\n"), "c_name"), "choice_a": F.col("c_mktsegment"), "choice_b": F.col("c_nationkey"), "answer": F.lit("A")}
    c.select(*[values.get(n, blank).alias(n) for n in rd.MCQ_COLUMNS]).write.csv(f"{folder}/test.csv", header=True)
    return rd.read_mcq(spark, folder, "test").select("idx", "question", F.col("choices")["A"].alias("a"), F.col("choices")["B"].alias("b"),
                                                     F.col("choices")["D"].alias("d"), "answer")


@query("src_04", r"SELECT doc_id::VARCHAR AS idx, source, doc_id::VARCHAR AS faiss_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents WHERE regexp_matches(text, '\S')")
def src_04(spark, sf):
    folder = scratch_path(spark, "passages")
    d = fx.table(spark, sf, "documents")
    d.select(F.col("doc_id").alias("idx"), "source", F.col("doc_id").alias("faiss_id"), "text").write.csv(
        f"{folder}/train.tsv", header=True, sep="\t", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rd.read_passages(spark, folder, "train").select("idx", "source", "faiss_id", F.md5("text").alias("digest"))


@query("src_05", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS digest, lang, source FROM documents")
def src_05(spark, sf):
    path = scratch_path(spark, "corpus")
    wr.write_corpus(corpus(spark, sf), path)
    return rd.read_corpus(spark, path).select("doc_id", F.md5("text").alias("digest"), F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


@query("src_06", "SELECT 'part-r-' || item_id AS doc_id, md5(text) AS digest FROM benchmark", None)
def src_06(spark, sf):
    """One folder per item; the stem of the single file in it is replaced by the item's folder name."""
    path = scratch_path(spark, "texts")
    items = fx.table(spark, sf, "benchmark").select("item_id", "text")
    items.repartition("item_id").write.partitionBy("item_id").option("lineSep", "\n").text(path)
    rows = rd.read_text_folder(spark, path)
    return rows.select(F.concat(F.lit("part-r-"), F.regexp_extract(F.col("metadata")["path"], r"item_id=(\d+)", 1)).alias("doc_id"),
                       F.md5(F.regexp_replace("text", "\n$", "")).alias("digest"))


@query("src_07", "SELECT case_id, rnk, g_max, g_avg FROM v_predictions")
def src_07(spark, sf):
    """Half of the rows under the new score names, half under the old ones."""
    p = fx.predictions(spark, sf)
    new = p.filter("case_id % 2 = 0").select("case_id", "rnk", F.col("g_max").alias("grounding_max"), F.col("g_avg").alias("grounding_avg"))
    old = p.filter("case_id % 2 = 1").select("case_id", "rnk", F.col("g_max").alias("combined_sentence_max_score"),
                                             F.col("g_avg").alias("combined_sentence_avg_score"))
    path = scratch_path(spark, "generations")
    new.write.json(f"{path}/new")
    old.write.json(f"{path}/old")
    schema = "case_id bigint, rnk int, grounding_max double, grounding_avg double, combined_sentence_max_score double, combined_sentence_avg_score double"
    both = spark.read.schema(schema).json([f"{path}/new", f"{path}/old"])
    return rd.tolerant_scores(both).select("case_id", "rnk", "g_max", "g_avg")


@query("src_08", "SELECT case_id, replace(model, ' ', '_') AS model, cond FROM v_cases")
def src_08(spark, sf):
    path = scratch_path(spark, "metrics")
    cases = fx.cases(spark, sf).withColumn("model", F.replace("model", F.lit(" "), F.lit("_")))
    cases.select("case_id", F.col("model").alias("m"), F.col("cond").alias("c")).write.partitionBy("m", "c").json(path)
    rows = rd.read_metric_files(spark, path, T.StructType([T.StructField("case_id", T.LongType())]))
    return rows.select("case_id", F.regexp_replace(F.url_decode("model"), "^m=", "").alias("model"), F.regexp_replace("cond", "^c=", "").alias("cond"))


@query("src_09", "SELECT 'corpus::train::' || doc_id AS doc_id, md5(text) AS digest FROM documents WHERE trim(text) <> ''")
def src_09(spark, sf):
    return rd.dataset_corpus(fx.table(spark, sf, "documents"), "corpus", "train", "doc_id").select("doc_id", F.md5("text").alias("digest"))


def nested_results(spark, sf):
    """Nested results per case: five predictions at most, gold as a set of labels."""
    preds = fx.predictions(spark, sf).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "label"))), lambda p: F.struct(
        F.when(p["rnk"] == 3, "").otherwise(p["label"]).alias("label"), F.lit("r").alias("reasoning"))).alias("predictions"))
    gold = fx.gold(spark, sf).groupBy("case_id").agg(F.array_sort(F.collect_set("label")).alias("gold"))
    none = F.array().cast("array<struct<doc_id:string,text:string,score:double>>")
    return fx.cases(spark, sf).select("case_id", F.col("cond").alias("context")).join(preds, "case_id").join(gold, "case_id", "left").withColumn("evidence", none)


@query("src_10", """SELECT case_id, rnk, label, 'prediction' AS kind FROM v_predictions WHERE rnk <> 3 UNION ALL
    SELECT case_id, 0, label, 'gold' FROM v_gold WHERE case_id IN (SELECT case_id FROM v_predictions)""")
def src_10(spark, sf):
    flat = rd.flatten_results(nested_results(spark, sf))
    return flat["predictions"].select("case_id", "rnk", "label", F.lit("prediction").alias("kind")).unionByName(
        flat["gold"].select("case_id", F.lit(0).alias("rnk"), "label", F.lit("gold").alias("kind")))


@query("src_11", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS digest FROM documents")
def src_11(spark, sf):
    """No dataset is given, so the existing JSON lines win over the code documents."""
    from .texts import PREFIXES, codes
    from ..operators import filters as fl, texts as ot
    path = scratch_path(spark, "corpus")
    wr.write_corpus(corpus(spark, sf), path)
    fallback = ot.code_documents(fl.with_allowed_prefix(codes(spark, sf), PREFIXES))
    return rd.corpus_from_config(spark, jsonl=path, code_documents=fallback).select("doc_id", F.md5("text").alias("digest"))


@query("snk_01", "SELECT doc_id::VARCHAR AS doc_id, length(text) AS n, lang FROM documents")
def snk_01(spark, sf):
    path = scratch_path(spark, "export")
    wr.write_corpus(corpus(spark, sf), path)
    return spark.read.schema(rd.CORPUS).json(path).select("doc_id", F.length("text").alias("n"), F.col("metadata")["lang"].alias("lang"))


@query("snk_02", """SELECT case_id, count(*) AS n_predictions, string_agg(CASE WHEN rnk = 3 THEN '' ELSE label END, '|' ORDER BY rnk) AS labels FROM v_predictions GROUP BY 1""")
def snk_02(spark, sf):
    path = scratch_path(spark, "results")
    results = nested_results(spark, sf)
    wr.write_results(results, fx.cases(spark, sf).groupBy("cond").count(), {"mode": "ranked"}, path)
    back = ep.read_export(spark, path, "results")
    return back.select("case_id", F.size("predictions").cast("bigint").alias("n_predictions"), F.array_join(F.transform("predictions", lambda p: p["label"]), "|").alias("labels"))


@query("snk_03", "SELECT item_id AS case_id, md5(text) AS digest FROM benchmark")
def snk_03(spark, sf):
    """One folder per case: the benchmark items, a run of the size this form is for."""
    path = scratch_path(spark, "percase")
    wr.write_per_case(fx.table(spark, sf, "benchmark").withColumnRenamed("item_id", "case_id"), path)
    return spark.read.schema("text string, case_id bigint").json(path).select("case_id", F.md5("text").alias("digest"))


@query("snk_04", "SELECT 'aggregate' AS part, metric, k, round(avg(value), 6) + 0.0 AS value FROM v_metric_rows GROUP BY 2, 3 UNION ALL SELECT 'cases', metric, k, count(*)::DOUBLE FROM v_metric_rows GROUP BY 2, 3", VIEWS)
def snk_04(spark, sf):
    from ..operators.casemetrics import mean_metrics
    from .metrics import metric_table
    path = scratch_path(spark, "metrics")
    rows = metric_table(spark, sf)
    wr.write_metrics(mean_metrics(rows), rows, path)
    whole = ep.read_export(spark, path, "aggregate")
    cases = ep.read_export(spark, path, "per_case").groupBy("metric", "k").agg(F.count("*").cast("double").alias("value"))
    return whole.select(F.lit("aggregate").alias("part"), "metric", "k", r6("value")).unionByName(
        cases.select(F.lit("cases").alias("part"), "metric", "k", "value"))


@query("snk_07", """SELECT p.case_id, p.rnk, CASE WHEN matched THEN 'TRUE' ELSE 'FALSE' END AS verdict_text, matched AS is_correct FROM v_judged p
    WHERE case_id IN (SELECT case_id FROM v_gold)""", VIEWS)
def snk_07(spark, sf):
    tasks = pm.judge_tasks(fx.predictions(spark, sf), fx.gold(spark, sf))
    said = sh.judged(spark, sf).select("case_id", "rnk", F.when(F.col("matched"), "true, same").otherwise(" False").alias("raw_output"))
    path = scratch_path(spark, "audit")
    wr.judge_audit(tasks, said).write.parquet(path)
    return spark.read.parquet(path).select("case_id", "rnk", "verdict_text", "is_correct")


@query("snk_08", """SELECT error_type, count(*) AS n, least(count(*), 3) AS n_examples FROM (SELECT CASE attempt_id % 8 WHEN 0 THEN 'empty_output' WHEN 2 THEN 'extra_text'
    ELSE 'incomplete_json' END AS error_type FROM v_attempts WHERE NOT success) GROUP BY 1""")
def snk_08(spark, sf):
    from ..operators.extraction import error_examples
    from .extraction import failures, summary
    path = scratch_path(spark, "errors")
    summary(spark, sf).write.json(f"{path}/summary")
    error_examples(failures(spark, sf), 3).write.json(f"{path}/examples")
    examples = spark.read.schema("error_type string, example int").json(f"{path}/examples").groupBy("error_type").agg(F.count("*").alias("n_examples"))
    return spark.read.schema("error_type string, n bigint").json(f"{path}/summary").join(examples, "error_type").select("error_type", "n", "n_examples")


@query("set_06", "SELECT model, cond, count(*) AS n, count(extra) AS n_extra FROM (SELECT *, CASE WHEN cond = 'rag' THEN 1 END AS extra FROM v_cases) GROUP BY 1, 2")
def set_06(spark, sf):
    """Tables of different conditions, one with a column the others lack."""
    from functools import reduce
    cases = fx.cases(spark, sf)
    parts = [cases.filter(F.col("cond") == c) for c in ("baseline", "rag", "tuned")]
    parts[1] = parts[1].withColumn("extra", F.lit(1))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy("model", "cond").agg(F.count("*").alias("n"), F.count("extra").alias("n_extra"))
