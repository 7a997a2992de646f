"""Readers with explicit schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import strip

CORPUS = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
MCQ_COLUMNS = ("idx", "dataset", "source", "subject", "prompt", "question", "choice_a", "choice_b", "choice_c",
               "choice_d", "answer", "gold_passage", "gold_idx")
PASSAGE_COLUMNS = ("idx", "source", "faiss_id", "text")


def strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _clean(df: DataFrame) -> DataFrame:
    """Every value stripped, null as an empty string, unnamed columns dropped."""
    kept = [c for c in df.columns if c and not re.fullmatch(r"_c\d+", c)]
    return df.select(*[F.coalesce(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in kept])


def read_csv(spark: SparkSession, path, columns, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Quoted line breaks belong to their value, which makes a file one task; a folder of files is still many.
    ``multi_line=False`` splits large files whose values are known to hold no line breaks."""
    return _clean(spark.read.schema(strings(columns)).options(
        header=True, sep=sep, quote='"', escape='"', multiLine=multi_line, enforceSchema=False).csv(path))


def read_mcq(spark: SparkSession, folder: str, split: str = "all", limit: int | None = None) -> DataFrame:
    """MCQ cases of a split (``all`` is its own file), choices folded into a map."""
    rows = read_csv(spark, f"{folder}/{split}.csv", MCQ_COLUMNS)
    choices = F.create_map(*[x for letter in "abcd" for x in (F.lit(letter.upper()), F.col(f"choice_{letter}"))])
    out = rows.withColumn("choices", choices).drop(*[f"choice_{x}" for x in "abcd"])
    return out if limit is None else out.orderBy("idx").limit(limit)


def read_passages(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return read_csv(spark, f"{folder}/{split}.tsv", PASSAGE_COLUMNS, "\t").filter("text <> ''")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, missing metadata is empty; a line that isn't JSON and an empty corpus
    are errors."""
    rows = spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path).filter(F.col("doc_id").isNotNull() | F.col("text").isNotNull())
    if rows.limit(1).count() == 0:
        raise ValueError(f"no documents under {path}")
    return rows.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def read_text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every .txt below a folder: file stem as id, path and name as metadata."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    path, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    return rows.select(F.regexp_replace(F.url_decode(name), r"\.txt$", "").alias("doc_id"), F.col("value").alias("text"),
                       F.create_map(F.lit("path"), path, F.lit("name"), F.url_decode(name)).alias("metadata"))


def dataset_corpus(rows: DataFrame, name: str, split: str, position: str, text: str = "text",
                   max_records: int | None = None) -> DataFrame:
    """Dataset rows as a corpus: blank texts skipped, id from the position column, which counts
    skipped rows too, and a cap on the position."""
    kept = rows.filter(strip(F.coalesce(F.col(text), F.lit(""))) != "")
    if max_records is not None:
        kept = kept.filter(F.col(position) < max_records)
    return kept.select(F.concat_ws("::", F.lit(name), F.lit(split), F.col(position).cast("string")).alias("doc_id"), F.col(text).alias("text"))


def either_generation(df: DataFrame, new: str, old: str) -> Column:
    """A score under its new or its old name; an error if the table has neither."""
    present = [c for c in (new, old) if c in df.columns]
    if not present:
        raise ValueError(f"neither {new!r} nor {old!r} is a column")
    return F.coalesce(*[F.col(c).cast("double") for c in present])


def tolerant_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("g_max", either_generation(df, "grounding_max", "combined_sentence_max_score")).withColumn(
        "g_avg", either_generation(df, "grounding_avg", "combined_sentence_avg_score"))


def read_metric_files(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Metric files below ``root/model/condition/``, without those of single workers."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(root)
    path = F.col("_metadata.file_path")
    return rows.select("*", path.alias("_path")).filter(~F.contains(F.col("_path"), F.lit("worker"))).select(
        *[f.name for f in schema.fields],
        F.regexp_extract("_path", r"/([^/]+)/([^/]+)/[^/]+$", 1).alias("model"),
        F.regexp_extract("_path", r"/([^/]+)/([^/]+)/[^/]+$", 2).alias("cond"))


def flatten_results(results: DataFrame) -> dict[str, DataFrame]:
    """Nested results as flat tables: cases, evidence, predictions (blank labels dropped), gold."""
    def spread(column, *fields):
        return results.select("case_id", F.posexplode(column).alias("pos", "x")).select(
            "case_id", (F.col("pos") + 1).alias("rnk"), *[F.col(f"x.{f}").alias(f) for f in fields])
    return {
        "cases": results.select("case_id", "context"),
        "evidence": spread("evidence", "doc_id", "text", "score"),
        "predictions": spread("predictions", "label", "reasoning").filter(strip(F.col("label")) != ""),
        "gold": results.select("case_id", F.explode("gold").alias("label")),
    }


def corpus_from_config(spark: SparkSession, dataset: DataFrame | None = None, jsonl: str | None = None,
                       text_folder: str | None = None, code_documents: DataFrame | None = None) -> DataFrame:
    """The first source that is given: dataset, JSON lines that exist, text folder (kept as JSON
    lines under ``jsonl`` if that is named), code-group documents; an error if there is none."""
    from .writers import write_corpus
    empty = F.create_map().cast("map<string,string>")
    if dataset is not None:
        return dataset.select("doc_id", "text", empty.alias("metadata"))
    if jsonl is not None and _exists(spark, jsonl):
        return read_corpus(spark, jsonl)
    if text_folder is not None:
        docs = read_text_folder(spark, text_folder)
        if jsonl is None:
            return docs
        write_corpus(docs, jsonl)
        return read_corpus(spark, jsonl)
    if code_documents is not None:
        return code_documents.select("doc_id", "text", empty.alias("metadata"))
    raise ValueError("no corpus source is given")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def load_cases(notes: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Notes with at least one label; ``limit`` keeps the first cases by id."""
    from ..operators.texts import assemble_cases, label_multiset
    out = assemble_cases(notes, label_multiset(labels))
    return out if limit is None else out.orderBy("case_id").limit(limit)
