"""Retrieval queries (RET, TOP-01..03, MET-03/04, SET-02/05, JOIN-07, SNK-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import cells as cs, impacts as im, lexical as lx, ranking as rk, retrieval as rt, topk
from ..operators.pairs import mentioned_labels
from ..session import scratch_path
from .registry import query
from .shared import r6
from .vectors import VEC, embeddings, label_centroids

K = 10


def corpus(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", "text")


def items(spark, sf):
    return fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical_hits(spark, sf, k=K):
    return lx.search(corpus(spark, sf), items(spark, sf), k)


def dense_queries(spark, sf):
    """One query per label: the centroid of all its vectors."""
    return label_centroids(spark, sf).select(F.col("label").alias("query_id"), F.col("centroid").alias("vector"))


RET = {
    **VEC,
    "v_dense": """SELECT c.label AS query_id, e.vec_id AS doc_id, e.label,
        round(list_sum(list_transform(list_zip(embedding, c), lambda z: z[1]::DOUBLE * z[2])) / n, 10) + 0.0 AS score
        FROM v_norm e CROSS JOIN v_centroid_list c""",
    "v_dense_rank": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rnk FROM v_dense",
    "v_first": "SELECT query_id, doc_id, min(rnk) AS first FROM v_hits GROUP BY 1, 2",
}


@query("ret_01", "SELECT query_id, rnk, doc_id, round(score, 6) + 0.0 AS score FROM v_hits", RET)
def ret_01(spark, sf):
    return lexical_hits(spark, sf).select("query_id", "rnk", "doc_id", r6("score"))


@query("ret_01_impacts", "SELECT query_id, rnk, doc_id, round(score, 6) + 0.0 AS score FROM v_hits", RET)
def ret_01_impacts(spark, sf):
    """The same search over impact-ordered postings on disk, which skips the blocks that can't matter."""
    path = scratch_path(spark, "impacts")
    im.write_impacts(corpus(spark, sf), path)
    hits, _ = im.search(im.open_impacts(spark, path), items(spark, sf), K)
    return hits.select("query_id", "rnk", "doc_id", r6("score"))


@query("top_01", "SELECT query_id, rnk, doc_id FROM v_hits WHERE rnk <= 3", RET)
def top_01(spark, sf):
    hits = lexical_hits(spark, sf).drop("rnk")
    return topk.top_k(hits, 3, ["query_id"], [F.desc("score"), F.asc("doc_id")]).select("query_id", "rnk", "doc_id")


@query("ret_02", "SELECT query_id, rnk, doc_id, round(score, 6) + 0.0 AS score FROM v_dense_rank WHERE rnk <= 10", RET)
def ret_02(spark, sf):
    return rt.dense_search(embeddings(spark, sf), dense_queries(spark, sf), K).select("query_id", "rnk", "doc_id", r6("score"))


def cell_index(spark, sf, n_cells=16):
    """Every vector by cell, written below the shared folder."""
    path = scratch_path(spark, "cells")
    cs.write_cells(embeddings(spark, sf), path, n_cells)
    return cs.open_cells(spark, path)


def held_out_queries(spark, sf):
    """Queries like the label centroids, which calibrate the search: centroids of an eighth of a label's vectors."""
    eighths = embeddings(spark, sf).withColumn("eighth", F.concat_ws("/", "label", F.pmod(F.xxhash64("doc_id"), F.lit(8))))
    return vx.centroids(eighths, "eighth", "vector").select(F.col("eighth").alias("query_id"), F.col("centroid").alias("vector"))


@query("ret_03")
def ret_03(spark, sf):
    """Search of the cells that held-out queries need for a recall of 0.95, beside exact search: the share of the exact hits each
    query keeps, and the share of the rows it reads."""
    docs, asked = embeddings(spark, sf), dense_queries(spark, sf)
    index = cell_index(spark, sf)
    n_probe = cs.calibrated(index, held_out_queries(spark, sf), K)
    pruned = cs.search(index, asked, K, n_probe)
    exact = rt.dense_search(docs, asked, K).select("query_id", "doc_id", F.lit(1).alias("exact"))
    return pruned.join(exact, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("n"), F.count("exact").alias("kept"), r6(F.count("exact") / K, "recall"), F.lit(n_probe).alias("n_probe"))


@query("ret_03_exact", "SELECT query_id, rnk, doc_id, round(score, 6) + 0.0 AS score FROM v_dense_rank WHERE rnk <= 10", RET)
def ret_03_exact(spark, sf):
    """The same index, read until no unread cell can hold one of the k best."""
    hits, _ = cs.exact_search(cell_index(spark, sf), dense_queries(spark, sf), K, 4)
    return hits.select("query_id", "rnk", "doc_id", r6("score"))


@query("ret_04", """SELECT query_id, rnk, doc_id, round(score, 6) + 0.0 AS score FROM (
    SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.doc_id) AS rnk FROM v_scored s
    JOIN documents d ON s.doc_id = d.doc_id JOIN benchmark b ON b.item_id = s.query_id
    WHERE contains(lower(b.text), d.lang) OR contains(lower(b.text), d.source)
        OR NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lang AS c FROM documents UNION SELECT DISTINCT source FROM documents)
            WHERE contains(lower(b.text), c))) WHERE rnk <= 10""", RET)
def ret_04(spark, sf):
    from ..operators.texts import mentions, vocabulary
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", F.array("lang", "source").alias("concepts"))
    asked = items(spark, sf)
    named = mentions(asked, vocabulary(docs), "query_id").groupBy("query_id").agg(F.collect_set("concept").alias("concepts"))
    asked = asked.join(named, "query_id", "left").withColumn(
        "concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    return lx.search(docs, asked, K, restrict=True).select("query_id", "rnk", "doc_id", r6("score"))


def tagged(spark, sf):
    docs = embeddings(spark, sf).withColumn("concepts", F.array(F.concat(F.lit("label "), "label")))
    asked = dense_queries(spark, sf).withColumn("concepts", F.array(F.concat(F.lit("label "), "query_id")))
    return docs, asked


@query("ret_05", """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rnk, doc_id, round(score, 6) + 0.0 AS score
    FROM v_dense_rank WHERE rnk <= 50 AND label = query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5""", RET)
def ret_05(spark, sf):
    docs, asked = tagged(spark, sf)
    return rt.overfetch_search(docs, asked, 5).select("query_id", "rnk", "doc_id", r6("score"))


@query("ret_06", """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rnk, doc_id, round(score, 6) + 0.0 AS score
    FROM v_dense WHERE label = query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""", RET)
def ret_06(spark, sf):
    docs, asked = tagged(spark, sf)
    return rt.dense_search(docs, asked, K).select("query_id", "rnk", "doc_id", r6("score"))


PART_SQL = r"""SELECT item_id AS case_id, i - 1 AS part_idx, s[i] AS text FROM (SELECT item_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
    SELECT item_id, list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?])[\s\p{Z}]+([A-Z])',
        '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS s FROM benchmark))"""
FUSED = {
    **RET,
    "v_parts": PART_SQL,
    "v_pterms": r"""SELECT case_id, part_idx, term, count(*) AS n FROM (SELECT case_id, part_idx,
        unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM v_parts) GROUP BY 1, 2, 3""",
    "v_praw": """SELECT case_id, part_idx, term, n::DOUBLE / sum(n) OVER (PARTITION BY case_id, part_idx)
        * coalesce(idf, ln(1.0::DOUBLE + (SELECT count(*) FROM documents)) + 1) AS w FROM v_pterms LEFT JOIN v_idf USING (term)""",
    "v_pweight": "SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY case_id, part_idx)) AS weight FROM v_praw",
    "v_pdot": "SELECT case_id, part_idx, doc_id, round(sum(q.weight * d.weight), 10) + 0.0 AS score FROM v_pweight q JOIN v_weight d USING (term) GROUP BY 1, 2, 3",
    "v_phits": "SELECT * FROM v_pdot QUALIFY row_number() OVER (PARTITION BY case_id, part_idx ORDER BY score DESC, doc_id) <= 5",
}


@query("ret_07", """SELECT case_id, rnk, doc_id, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY case_id
    ORDER BY score DESC, doc_id) AS rnk FROM (SELECT case_id, doc_id, max(score) AS score FROM v_phits GROUP BY 1, 2)) WHERE rnk <= 5""", FUSED)
def ret_07(spark, sf):
    parts = fx.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("case_id"), F.posexplode(tx.sentences(F.col("text"))).alias("part_idx", "text"))
    return rt.fused_search(corpus(spark, sf), parts, 5).select("case_id", "rnk", "doc_id", r6("score"))


@query("ret_07_sections", """SELECT case_id, rnk, doc_id, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY case_id
    ORDER BY score DESC, doc_id) AS rnk FROM (SELECT case_id, doc_id, max(score) AS score FROM v_phits GROUP BY 1, 2)) WHERE rnk <= 5""",
    {**FUSED, "v_parts": """SELECT item_id AS case_id, 0 AS part_idx, CASE WHEN item_id % 2 = 0 THEN regexp_extract(text, '^[^.]+[.]') ELSE text END AS text FROM benchmark
        UNION ALL SELECT item_id, 1, 'sinus ' || translate(text, chr(10), ' ') FROM benchmark WHERE item_id % 2 = 0"""})
def ret_07_sections(spark, sf):
    """Even items as texts of two labelled sections, odd ones without any, which are asked as a whole."""
    items = fx.table(spark, sf, "benchmark")
    labelled = F.concat(F.lit("Chief complaint: "), F.regexp_extract("text", "^[^.]+[.]", 0), F.lit("\nECG: sinus "), F.translate("text", "\n", " "))
    cases = items.select(F.col("item_id").alias("case_id"), F.when(F.col("item_id") % 2 == 0, labelled).otherwise(F.col("text")).alias("context"))
    return rt.fused_search(corpus(spark, sf), rt.section_queries(cases), 5).select("case_id", "rnk", "doc_id", r6("score"))


@query("ret_08", """SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rnk, round(score, 6) + 0.0 AS score
    FROM v_relevance JOIN v_scored USING (query_id, doc_id)""", RET)
def ret_08(spark, sf):
    return rt.align(corpus(spark, sf), items(spark, sf), fx.relevance(spark, sf)).select("query_id", "doc_id", "rnk", r6("score"))


@query("ret_09", """SELECT query_id AS case_id, rnk, h.doc_id, md5(text) AS digest, round(score, 6) + 0.0 AS score
    FROM v_hits h JOIN documents d ON h.doc_id = d.doc_id""", RET)
def ret_09(spark, sf):
    cases = items(spark, sf).select(F.col("query_id").alias("case_id"))
    rows = rt.evidence_for_cases(cases, lexical_hits(spark, sf), corpus(spark, sf))
    return rows.select("case_id", "rnk", "doc_id", F.md5("text").alias("digest"), r6("score"))


@query("ret_10", """SELECT r.query_id, r.doc_id, e.label, e.vec_id IS NOT NULL AS found FROM v_relevance r LEFT JOIN embeddings e ON e.vec_id = r.doc_id""")
def ret_10(spark, sf):
    return rt.lookup(embeddings(spark, sf), fx.relevance(spark, sf)).select("query_id", "doc_id", "label", "found")


def judged_hits(spark, sf):
    return lexical_hits(spark, sf), fx.relevance(spark, sf), items(spark, sf).select("query_id")


@query("met_03", """SELECT k, round(avg((h > 0)::INT), 6) + 0.0 AS success, round(avg(CASE WHEN n > 0 THEN h::DOUBLE / n ELSE 0 END), 6) + 0.0 AS precision,
    round(avg(CASE WHEN r > 0 THEN h::DOUBLE / r ELSE 0 END), 6) + 0.0 AS recall FROM (
    SELECT item_id, k, count(f.doc_id) AS n, count(v.doc_id) AS h, (SELECT count(*) FROM v_relevance x WHERE x.query_id = item_id) AS r
    FROM benchmark CROSS JOIN range(1, 6) t(k) LEFT JOIN v_first f ON f.query_id = item_id AND first <= k
    LEFT JOIN v_relevance v ON v.query_id = item_id AND v.doc_id = f.doc_id GROUP BY 1, 2) GROUP BY 1""", RET)
def met_03(spark, sf):
    return rk.retrieval_metrics(*judged_hits(spark, sf), 5).select("k", r6("success"), r6("precision"), r6("recall"))


@query("met_04", """SELECT round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) + 0.0 AS mrr, count(*) AS n_queries FROM benchmark
    LEFT JOIN (SELECT query_id, min(first) AS f FROM v_first JOIN v_relevance USING (query_id, doc_id) GROUP BY 1) ON query_id = item_id""", RET)
def met_04(spark, sf):
    return rk.mean_reciprocal_rank(*judged_hits(spark, sf)).select(r6("mrr"), "n_queries")


@query("set_02", "SELECT query_id, doc_id FROM v_hits WHERE rnk <= 5 INTERSECT SELECT query_id, doc_id FROM v_relevance", RET)
def set_02(spark, sf):
    hits = lexical_hits(spark, sf, 5).select("query_id", "doc_id").distinct()
    return hits.join(fx.relevance(spark, sf), ["query_id", "doc_id"], "left_semi")


@query("set_05", "SELECT query_id, doc_id FROM v_relevance EXCEPT SELECT query_id, doc_id FROM v_hits", RET)
def set_05(spark, sf):
    return fx.relevance(spark, sf).join(lexical_hits(spark, sf), ["query_id", "doc_id"], "left_anti")


@query("join_07", """SELECT DISTINCT item_id AS case_id, label FROM (
        SELECT item_id, upper(regexp_extract(text, '^[A-Za-z]+ ([A-Za-z]+ [A-Za-z]+)', 1)) AS label FROM benchmark
        UNION SELECT item_id, regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)[.]', 1) FROM benchmark UNION SELECT item_id, 'no such label' FROM benchmark) g
    JOIN v_relevance r ON r.query_id = item_id JOIN documents d ON d.doc_id = r.doc_id
    WHERE label <> '' AND contains(lower(d.text), lower(label))""")
def join_07(spark, sf):
    """Labels from inside and from the end of an item's sentences, in mixed case, in the documents relevant to it."""
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    labels = F.array(F.upper(F.regexp_extract("text", "^[A-Za-z]+ ([A-Za-z]+ [A-Za-z]+)", 1)), F.regexp_extract("text", "([A-Za-z]+ [A-Za-z]+)[.]", 1),
                     F.lit("no such label"))
    evidence = fx.relevance(spark, sf).join(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id").withColumnRenamed("query_id", "case_id")
    return mentioned_labels(evidence, items.select("case_id", F.explode(labels).alias("label")))


SECTION_PAIRS = {**VEC, "v_sp": """SELECT e.label AS case_id, e.vec_id AS sentence_idx, c.label AS section_idx,
    round(list_sum(list_transform(list_zip(embedding, c), lambda z: z[1]::DOUBLE * z[2])) / (n + 1e-8::DOUBLE), 10) AS sim
    FROM v_norm e CROSS JOIN v_centroid_list c"""}


@query("top_02", """SELECT sentence_idx, section_idx, row_number() OVER (PARTITION BY sentence_idx ORDER BY sim DESC, section_idx) AS rnk, round(sim, 6) + 0.0 AS sim
    FROM v_sp QUALIFY row_number() OVER (PARTITION BY sentence_idx ORDER BY sim DESC, section_idx) <= 3""", SECTION_PAIRS)
def top_02(spark, sf):
    """The three centroids most similar to each vector, as sections to a sentence."""
    from ..operators.sections import nearest_sections
    sentences = embeddings(spark, sf).select(F.col("doc_id").alias("sentence_idx"), "vector")
    sections = label_centroids(spark, sf).select(F.col("label").alias("section_idx"), F.col("centroid").alias("vector"))
    return nearest_sections(sentences, sections, 3).select("sentence_idx", "section_idx", "rnk", r6("sim"))


@query("top_03", """SELECT sentence_idx, arg_max(section_idx, {'a': sim, 'b': -section_idx}) AS section_idx FROM v_sp GROUP BY 1""", SECTION_PAIRS)
def top_03(spark, sf):
    from ..operators.sections import best_section
    sentences = embeddings(spark, sf).select(F.col("doc_id").alias("sentence_idx"), "vector")
    sections = label_centroids(spark, sf).select(F.col("label").alias("section_idx"), F.col("centroid").alias("vector"))
    return best_section(sentences, sections)


@query("snk_06", """SELECT label AS cell_id, count(*) AS n_vectors, 64 AS dimension, (SELECT count(*) FROM embeddings) AS n_all,
    round(max(list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]))), 6) + 0.0 AS best FROM embeddings
    CROSS JOIN (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) GROUP BY 1""")
def snk_06(spark, sf):
    """An index saved by cell and searched from its files: the best inner product with the first vector in every cell."""
    from ..functions.vectors import dot
    from ..session import scratch_path
    from ..sources.writers import load_index, save_index
    path = scratch_path(spark, "index")
    save_index(embeddings(spark, sf).withColumnRenamed("label", "cell_id"), path)
    vectors, meta = load_index(spark, path)
    asked = vectors.select(F.min_by("vector", "doc_id").alias("q"))
    # One row on either broadcast side.
    rows = vectors.join(F.broadcast(meta), F.lit(True)).join(F.broadcast(asked), F.lit(True))
    return rows.groupBy(F.col("cell_id").cast("int").alias("cell_id")).agg(
        F.count("*").alias("n_vectors"), F.max("dimension").alias("dimension"), F.max("n_vectors").alias("n_all"), r6(F.max(dot(F.col("vector"), F.col("q"))), "best"))
