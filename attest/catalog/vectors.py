"""Vector queries (VEC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import vectors as vx
from ..operators import lexical as lx
from ..operators.retrieval import align
from .registry import query
from .shared import r6

VEC = {
    "v_norm": "SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings",
    "v_mean": """SELECT label, pos, avg(v::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
        FROM embeddings) GROUP BY 1, 2""",
    "v_centroid": "SELECT label, pos, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM v_mean",
    "v_centroid_list": "SELECT label, list(v ORDER BY pos) AS c FROM v_centroid GROUP BY 1",
    "v_terms": r"""SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term
        FROM documents) GROUP BY 1, 2""",
    "v_idf": """SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM v_terms GROUP BY 1""",
    "v_raw": "SELECT doc_id, term, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) * idf AS w FROM v_terms JOIN v_idf USING (term)",
    "v_weight": "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM v_raw",
    "v_qterms": r"""SELECT item_id AS query_id, term, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term
        FROM benchmark) GROUP BY 1, 2""",
    "v_qraw": """SELECT query_id, term, n::DOUBLE / sum(n) OVER (PARTITION BY query_id)
        * coalesce(idf, ln(1.0::DOUBLE + (SELECT count(*) FROM documents)) + 1) AS w FROM v_qterms LEFT JOIN v_idf USING (term)""",
    "v_qweight": "SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM v_qraw",
    "v_dot": """SELECT query_id, doc_id, round(sum(q.weight * d.weight), 10) AS s FROM v_qweight q JOIN v_weight d USING (term) GROUP BY 1, 2""",
    "v_scored": """SELECT item_id AS query_id, d.doc_id, coalesce(s, 0.0::DOUBLE) + 0.0 AS score FROM benchmark CROSS JOIN documents d
        LEFT JOIN v_dot ON query_id = item_id AND v_dot.doc_id = d.doc_id""",
    "v_hits": """SELECT query_id, rnk, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rnk
        FROM v_scored) WHERE rnk <= 10""",
}


def embeddings(spark, sf):
    return fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def label_centroids(spark, sf):
    return vx.centroids(embeddings(spark, sf), "label", "vector")


@query("vec_01", """SELECT e.vec_id AS doc_id, round(list_sum(list_transform(list_zip(embedding, c), lambda z: z[1]::DOUBLE * z[2])) / n, 6) + 0.0 AS score
    FROM v_norm e JOIN v_centroid_list USING (label)""", VEC)
def vec_01(spark, sf):
    """Cosine of every vector with the centroid of its label."""
    rows = embeddings(spark, sf).join(label_centroids(spark, sf), "label")
    return rows.select("doc_id", r6(vx.cosine(F.col("vector"), F.col("centroid")), "score"))


@query("vec_02", "SELECT query_id, r.doc_id, round(score, 6) + 0.0 AS score FROM v_relevance r JOIN v_scored USING (query_id, doc_id)", VEC)
def vec_02(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return align(docs, items, fx.relevance(spark, sf)).select("query_id", "doc_id", r6("score"))


@query("vec_03", "SELECT vec_id AS doc_id, pos, round(v / n, 6) + 0.0 AS v FROM (SELECT vec_id, n, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM v_norm)", VEC)
def vec_03(spark, sf):
    return embeddings(spark, sf).select("doc_id", F.posexplode(vx.normalise(F.col("vector"))).alias("pos", "x")).select(
        "doc_id", "pos", r6("x", "v"))


@query("vec_04", "SELECT label, pos - 1 AS pos, round(v, 6) + 0.0 AS v FROM v_centroid", VEC)
def vec_04(spark, sf):
    return label_centroids(spark, sf).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", r6("x", "v"))


@query("vec_05", "SELECT doc_id, term, round(weight, 6) + 0.0 AS weight FROM v_weight", VEC)
def vec_05(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return lx.weights(docs, lx.frequency_table(docs), docs.count()).select("doc_id", "term", r6("weight"))


@query("vec_06", """SELECT d.doc_id, lang, label, embedding[1]::DOUBLE AS first, e.vec_id IS NOT NULL AS found FROM documents d
    LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def vec_06(spark, sf):
    """Precomputed vectors attached to texts; a text without one is reported."""
    from ..operators.retrieval import lookup
    wanted = fx.table(spark, sf, "documents").select("doc_id", "lang")
    return lookup(embeddings(spark, sf), wanted).select(
        "doc_id", "lang", "label", F.get("vector", F.lit(0)).cast("double").alias("first"), "found")
