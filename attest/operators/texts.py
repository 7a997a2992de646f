"""Corpus tables from texts: chunks, sections, sentences, concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx


def chunk_table(docs: DataFrame, size: int = 320, overlap: int = 64) -> DataFrame:
    """One row per chunk. A text of one chunk keeps its id; an empty text keeps one row."""
    pieces = docs.withColumn("pieces", tx.chunks(F.col("text"), size, overlap)).withColumn(
        "n_chunks", F.size("pieces"))
    rows = pieces.select("doc_id", "n_chunks", "text", F.posexplode_outer("pieces").alias("chunk_idx", "piece"))
    ident = F.col("doc_id").cast("string")
    many = F.col("n_chunks") > 1
    return rows.select(
        F.when(many, F.concat(ident, F.lit("::chunk-"), F.col("chunk_idx"))).otherwise(ident).alias("chunk_id"),
        F.col("doc_id").alias("source_doc_id"), F.coalesce("chunk_idx", F.lit(0)).alias("chunk_idx"),
        F.coalesce("piece", F.lit("")).alias("text"))


def section_table(docs: DataFrame) -> DataFrame:
    found = tx.sections(F.col("text"))
    return docs.select("doc_id", F.posexplode(found).alias("section_idx", "s")).select(
        "doc_id", "section_idx", F.col("s.title").alias("title"), F.col("s.body").alias("body"))


def section_chunks(docs: DataFrame, size: int = 400, overlap: int = 80) -> DataFrame:
    """Chunks that never span sections; ``section_index`` counts sections that have a chunk."""
    whole = F.transform(tx.sections(F.col("text")), lambda s: F.struct(
        s["title"].alias("title"), tx.chunks(s["body"], size, overlap).alias("pieces")))
    kept = F.filter(whole, lambda s: F.size(s["pieces"]) > 0)
    rows = docs.select("doc_id", F.posexplode(kept).alias("section_index", "s")).select(
        "doc_id", "section_index", F.col("s.title").alias("section_title"),
        F.posexplode("s.pieces").alias("chunk_index", "text"))
    return rows.withColumn("chunk_id", F.concat(
        F.col("doc_id").cast("string"), F.lit("::section-"), "section_index", F.lit("::chunk-"), "chunk_index"))


def mentions(texts: DataFrame, vocabulary: DataFrame, key: str, max_array: int = 2000, gram: int = 4) -> DataFrame:
    """(key, concept): vocabulary entries that are substrings of the lower-cased text.

    A vocabulary of counted size goes to every row as one array. A larger one is joined on the
    first ``gram`` characters of an entry, which must appear in the text, and then tested."""
    vocabulary = vocabulary.select("concept").distinct()
    if vocabulary.limit(max_array + 1).count() <= max_array:
        entries = vocabulary.agg(F.collect_list("concept").alias("entries"))
        hits = texts.select(key, F.lower("text").alias("low")).join(F.broadcast(entries), F.lit(True))
        return hits.select(key, F.explode(F.filter("entries", lambda c: F.contains(F.col("low"), c))).alias("concept"))
    short = mentions(texts, vocabulary.filter(F.length("concept") < gram), key, 1 << 20) if \
        vocabulary.filter(F.length("concept") < gram).limit(1).count() else None
    low = texts.select(key, F.lower("text").alias("low")).filter(F.length("low") >= gram)
    grams = low.select(key, "low", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("low") - gram + 1),
        lambda i: F.substr(F.col("low"), i, F.lit(gram))))).alias("gram"))
    keyed = vocabulary.filter(F.length("concept") >= gram).withColumn("gram", F.left("concept", F.lit(gram)))
    found = grams.join(keyed, "gram").filter(F.contains("low", "concept")).select(key, "concept")
    return found if short is None else found.unionByName(short)


def vocabulary(concepts: DataFrame) -> DataFrame:
    """Distinct concept tags of a corpus with an array column ``concepts``."""
    return concepts.select(F.explode("concepts").alias("concept")).distinct()


def code_documents(codes: DataFrame, placeholder: str = "cardiac diagnosis") -> DataFrame:
    """One document per code prefix: count, example titles, concept tags."""
    # Titles are cut to six per prefix inside the aggregate of distinct titles.
    titles = codes.filter(F.trim("title") != "").select("prefix", F.trim("title").alias("title")).distinct()
    from .topk import top_k
    six = top_k(titles, 6, ["prefix"], [F.col("title")], "place").groupBy("prefix").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]),
                     "; ").alias("examples"))
    counts = codes.groupBy("prefix").agg(F.count("*").alias("n"), F.count_distinct(F.trim("code")).alias("n_codes"))
    low = F.lower("prefix")
    return counts.join(six, "prefix", "left").select(
        F.concat(F.lit("icd-"), low).alias("doc_id"), "prefix", "n", "n_codes",
        F.concat(F.lit("ICD prefix "), "prefix", F.lit(" appears in the cardiac cohort (n="), F.col("n"),
                 F.lit("). Representative diagnoses include: "),
                 F.coalesce("examples", F.concat(F.lit("ICD "), "prefix", F.lit(" " + placeholder))),
                 F.lit(".")).alias("text"),
        F.array(F.lit("cardiac"), low, F.concat(F.lit("icd "), low)).alias("concepts"))


def label_multiset(rows: DataFrame) -> DataFrame:
    """Labels per case and kind with their copies and first position: the label list without
    gathering a case into one row."""
    return rows.groupBy("case_id", "kind", "label").agg(
        F.count("*").alias("copies"), F.min("position").alias("first_position"))


def assemble_cases(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases left-joined to their label counts; a case without any label is dropped."""
    counts = labels.groupBy("case_id").agg(
        F.sum(F.when(F.col("kind") == "diagnosis", F.col("copies")).otherwise(0)).alias("n_diagnoses"),
        F.sum(F.when(F.col("kind") == "procedure", F.col("copies")).otherwise(0)).alias("n_procedures"))
    return cases.join(counts, "case_id", "left").fillna(0, ["n_diagnoses", "n_procedures"]).filter(
        (F.col("n_diagnoses") + F.col("n_procedures") > 0) & F.col("case_id").isNotNull())
