"""Pair building and scoring joins (JOIN, UDF, TXT-19/20, GRD-05/08/09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as tx
from ..operators import grounding as gr, pairs as pr, prompts as pm, scoring as sc
from . import shared as sh
from .extraction import CRITIQUES, critiques
from .metrics import ANSWER_VIEWS, answers
from .registry import query
from .retrieval import RET, corpus, lexical_hits
from .shared import VIEWS, r6
from .texts import ANCHORS, SECTION_VIEWS

SENT = r"""list_filter(list_transform(string_split(regexp_replace(trim({c}, ' ' || chr(10)), '([.!?])[\s\p{{Z}}]+([A-Z])', '\1' || chr(1) || '\2', 'g'),
    chr(1)), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '')"""
OVERLAP = r"""CASE WHEN len(list_distinct(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+'))) > 0 THEN
    len(list_intersect(list_distinct(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+')), regexp_extract_all(lower(premise), '[\p{L}\p{N}_]+')))::DOUBLE
    / len(list_distinct(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+'))) ELSE 0.0::DOUBLE END"""
PAIR = {
    **VIEWS, **SECTION_VIEWS,
    "v_talk_pairs": f"""SELECT case_id, rnk, i - 1 AS sentence_idx, s[i] AS sentence, context AS premise FROM (
        SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, {SENT.format(c='reasoning')} AS s FROM v_reasoning))""",
    "v_anchor": """SELECT n.case_id, coalesce((SELECT string_agg(label || ': ' || content, chr(10) ORDER BY section_idx) FROM v_note_sections s
        WHERE s.case_id = n.case_id AND label IN ('Chief complaint', 'History of present illness')), '') AS anchor FROM v_notes n""",
}


@query("join_02", "SELECT p.case_id, rnk, p.label, g.label AS gold_label FROM v_predictions p JOIN v_gold g USING (case_id)")
def join_02(spark, sf):
    return pr.prediction_gold_pairs(fx.predictions(spark, sf), fx.gold(spark, sf)).select("case_id", "rnk", "label", "gold_label")


def talk_pairs(spark, sf):
    talk = fx.reasoning(spark, sf)
    sentences = talk.select("case_id", "rnk", F.posexplode(tx.sentences(F.col("reasoning"))).alias("sentence_idx", "sentence"))
    return sentences.join(talk.select("case_id", "rnk", F.col("context").alias("premise")), ["case_id", "rnk"])


@query("join_03", f"""SELECT t.case_id, t.rnk, i - 1 AS sentence_idx, s[i] AS sentence, p.rnk AS premise_idx FROM (
    SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, {SENT.format(c='reasoning')} AS s FROM v_reasoning)) t
    JOIN v_reasoning p ON p.case_id = t.case_id""", PAIR)
def join_03(spark, sf):
    talk = fx.reasoning(spark, sf)
    premises = talk.select("case_id", F.col("rnk").alias("premise_idx"), F.col("context").alias("premise"))
    return pr.premise_sentence_pairs(premises, talk).select("case_id", "rnk", "sentence_idx", "sentence", "premise_idx")


def note_sections(spark, sf):
    return fx.notes(spark, sf).select("case_id", tx.labelled_sections(F.col("context")).alias("sections"))


def note_evidence(spark, sf):
    """Fixture evidence of a note: its document's benchmark passages, if any."""
    found = fx.relevance(spark, sf)
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return found.join(items, "query_id").select(F.col("doc_id").alias("case_id"), F.col("query_id").alias("rnk"), "text")


@query("join_04", """SELECT a.case_id, 0 AS source, row_number() OVER (PARTITION BY a.case_id ORDER BY section_idx) - 1 AS idx,
        trim(anchor || chr(10) || label || ': ' || content, ' ' || chr(10)) AS premise FROM v_anchor a JOIN v_note_sections s USING (case_id)
        WHERE label NOT IN ('Chief complaint', 'History of present illness')
    UNION ALL SELECT r.doc_id, 1, query_id, trim(anchor || chr(10) || b.text, ' ' || chr(10)) FROM v_relevance r JOIN benchmark b ON item_id = query_id
        JOIN v_anchor a ON a.case_id = r.doc_id""", PAIR)
def join_04(spark, sf):
    return pr.premise_rows(note_sections(spark, sf), note_evidence(spark, sf), ANCHORS)


@query("join_05", """SELECT case_id, idx, premise FROM (
    SELECT d.doc_id AS case_id, coalesce(r.query_id, 0) AS idx, d.lang || CASE WHEN r.query_id IS NULL THEN '' ELSE chr(10) || chr(10) || trim(b.text) END AS premise
    FROM documents d LEFT JOIN v_relevance r ON r.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = r.query_id WHERE NOT (d.doc_id % 2 = 0 AND r.query_id IS NULL)
    UNION ALL SELECT doc_id, -1, lang || chr(10) || chr(10) || trim(source) FROM documents WHERE doc_id % 2 = 0 AND trim(source) <> '')""", PAIR)
def join_05(spark, sf):
    """Even documents carry a gold passage (their source name) besides the passages found."""
    questions = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("anchor"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("gold_passage"))
    return pr.mcq_premise_rows(questions, note_evidence(spark, sf).withColumnRenamed("rnk", "idx"))


@query("join_06", """SELECT h.query_id AS case_id, CASE WHEN present THEN rnk ELSE rnk + 1 END AS rnk, md5(trim(d.text)) AS digest FROM v_hits h JOIN documents d USING (doc_id)
        JOIN (SELECT item_id AS query_id, bool_or(trim(d.text) = trim(b.text)) AS present FROM benchmark b JOIN v_hits h ON h.query_id = item_id
            JOIN documents d USING (doc_id) WHERE rnk <= 5 GROUP BY 1) USING (query_id) WHERE rnk <= 5
    UNION ALL SELECT item_id, 1, md5(trim(b.text)) FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM v_hits h JOIN documents d USING (doc_id)
        WHERE h.query_id = item_id AND rnk <= 5 AND trim(d.text) = trim(b.text))""", RET)
def join_06(spark, sf):
    hits = lexical_hits(spark, sf, 5)
    evidence = hits.join(corpus(spark, sf), "doc_id").select(F.col("query_id").alias("case_id"), "rnk", "text")
    gold = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    return pr.with_gold_passage(evidence, gold).select("case_id", "rnk", F.md5("text").alias("digest"))


@query("join_06_choices", """WITH e AS (SELECT doc_id % 50 AS case_id, doc_id AS rnk, trim(lang) AS text FROM documents WHERE trim(lang) <> '' AND doc_id % 3 > 0),
    g AS (SELECT item_id AS case_id, 'en' AS text FROM benchmark),
    both_ AS (SELECT case_id, rnk, text FROM e UNION ALL SELECT case_id, 0, text FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.case_id = g.case_id AND e.text = g.text))
    SELECT 'retrieved' AS choice, case_id, text, count(*) AS n FROM e GROUP BY 2, 3 UNION ALL SELECT 'gold', case_id, text, count(*) FROM g GROUP BY 2, 3
    UNION ALL SELECT 'retrieved + gold', case_id, text, count(*) FROM both_ GROUP BY 2, 3""")
def join_06_choices(spark, sf):
    """Every choice of evidence; blank evidence (every third document) goes."""
    d = fx.table(spark, sf, "documents")
    evidence = d.select((F.col("doc_id") % 50).alias("case_id"), F.col("doc_id").alias("rnk"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).otherwise(" \t").alias("text"))
    gold = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.lit("en ").alias("text"))
    parts = [pr.chosen_evidence(evidence, gold, c).select(F.lit(c).alias("choice"), "case_id", "text") for c in pr.EVIDENCE]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("choice", "case_id", "text").agg(F.count("*").alias("n"))


@query("join_08", """SELECT case_id, round(CASE WHEN n_pred > 0 AND n_gold > 0 THEN hits::DOUBLE / n_pred ELSE 0.0::DOUBLE END, 6) + 0.0 AS precision,
    round(CASE WHEN n_pred > 0 AND n_gold > 0 THEN hits::DOUBLE / n_gold ELSE 0.0::DOUBLE END, 6) + 0.0 AS recall FROM v_tally WHERE k = 3""", VIEWS)
def join_08(spark, sf):
    out = pr.exact_match_at_k(fx.predictions(spark, sf), fx.gold(spark, sf), fx.cases(spark, sf), 3)
    return out.select("case_id", r6("precision"), r6("recall"))


@query("join_09", "SELECT case_id, CASE WHEN coalesce(correct, false) THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy FROM v_answers", ANSWER_VIEWS)
def join_09(spark, sf):
    rows = answers(spark, sf)
    given = rows.select("case_id", F.concat(F.lit(" "), F.lower("answer")).alias("answer"))
    return pr.letter_accuracy(given, rows.select("case_id", "gold_answer")).select("case_id", "accuracy")


@query("join_10", """SELECT case_id, round(avg((best >= 0.8::DOUBLE)::INT), 6) + 0.0 AS accuracy, count(*) AS n FROM (
    SELECT p.case_id, p.rnk, coalesce(max(sim), -1.0::DOUBLE) AS best FROM v_predictions p LEFT JOIN v_gold g ON g.case_id = p.case_id
    LEFT JOIN (SELECT 'Brand#' || (a.vec_id + 1) AS a, 'Brand#' || (b.vec_id + 1) AS b,
        list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (a.n * b.n + 1e-8::DOUBLE) AS sim
        FROM v_norm a CROSS JOIN v_norm b WHERE a.vec_id < 25 AND b.vec_id < 25) ON a = p.label AND b = g.label WHERE p.rnk <= 3 GROUP BY 1, 2) GROUP BY 1""", RET)
def join_10(spark, sf):
    """Label vectors: the embedding whose id is the brand number less one."""
    vectors = fx.table(spark, sf, "embeddings").select(
        F.concat(F.lit("Brand#"), (F.col("vec_id") + 1).cast("string")).alias("label"), F.col("embedding").alias("vector"))
    out = pr.embedding_match(fx.predictions(spark, sf), fx.gold(spark, sf), vectors)
    return out.select("case_id", r6("accuracy"), "n")


@query("join_11", "SELECT case_id, rnk, label, matched, g_max, g_avg FROM v_rewards", VIEWS)
def join_11(spark, sf):
    return gr.reward_rows(fx.predictions(spark, sf), sh.judged(spark, sf)).select("case_id", "rnk", "label", "matched", "g_max", "g_avg")


@query("join_12", """SELECT c.case_id, round(g, 6) + 0.0 AS g_max FROM v_cases c LEFT JOIN (SELECT case_id, avg(g_max) AS g FROM v_predictions GROUP BY 1) p
    ON p.case_id = c.case_id""")
def join_12(spark, sf):
    grounding = fx.predictions(spark, sf).groupBy("case_id").agg(F.avg("g_max").alias("g_max"))
    return pr.merge_by_case(fx.cases(spark, sf), grounding).select("case_id", r6("g_max"))


CRIT = {**CRITIQUES, "v_some": "SELECT * FROM v_critiques WHERE critique_idx < 3",
        "v_match": """SELECT p.case_id, p.rnk, p.label, coalesce(c.confidence, n.confidence) AS confidence,
            CASE WHEN c.case_id IS NOT NULL THEN c.needs_evidence ELSE n.needs_evidence END AS needs_evidence FROM v_predictions p
            LEFT JOIN v_some c ON c.case_id = p.case_id AND c.critique_idx = p.rnk - 1
            LEFT JOIN (SELECT case_id, lower(label) AS key, arg_max(confidence, critique_idx) AS confidence,
                arg_max(needs_evidence, critique_idx) AS needs_evidence FROM v_some GROUP BY 1, 2) n ON n.case_id = p.case_id AND n.key = lower(p.label)"""}


def matched_critiques(spark, sf):
    """Fixture: critiques of the first three predictions only, so that some match by label."""
    some = critiques(spark, sf).filter("critique_idx < 3")
    return pr.match_critiques(fx.predictions(spark, sf), some)


@query("join_13", "SELECT * FROM v_match", CRIT)
def join_13(spark, sf):
    return matched_critiques(spark, sf).select("case_id", "rnk", "label", "confidence", "needs_evidence")


@query("rte_06", """SELECT case_id, rnk, CASE WHEN needs_evidence THEN 'LOW confidence - evidence retrieved' WHEN confidence IS NOT NULL
    THEN confidence || ' confidence' ELSE 'assessed' END AS tag FROM v_match""", CRIT)
def rte_06(spark, sf):
    tag = pm.confidence_tag(F.col("confidence"), F.col("needs_evidence"))
    return matched_critiques(spark, sf).select("case_id", "rnk", tag.alias("tag"))


@query("join_15", """SELECT subject_id AS case_id, baseline, rag FROM (SELECT subject_id, round(avg(CASE WHEN cond = 'baseline' THEN g_max END), 6) + 0.0 AS baseline,
    round(avg(CASE WHEN cond = 'rag' THEN g_max END), 6) + 0.0 AS rag FROM v_judged_run GROUP BY 1) WHERE baseline IS NOT NULL AND rag IS NOT NULL""", VIEWS)
def join_15(spark, sf):
    runs = sh.judged_with_run(spark, sf).groupBy(F.col("subject_id").alias("case_id"), F.col("cond").alias("run")).agg(F.avg("g_max").alias("value"))
    return pr.aligned_metrics(runs, ["baseline", "rag"]).select("case_id", r6("baseline"), r6("rag"))


@query("txt_19", r"""SELECT n.case_id, md5(concat('List the 5 most likely diagnoses as JSON with name and reasoning.', chr(10), chr(10), 'Patient:', chr(10), context,
    chr(10), chr(10), 'Retrieved evidence:', chr(10), coalesce(block, 'No documents provided.'), chr(10), chr(10), 'IMPORTANT: answer with JSON only.')) AS digest
    FROM v_notes n LEFT JOIN (SELECT doc_id, string_agg('Evidence ' || i || ':' || chr(10) || trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY i) AS block FROM (
        SELECT r.doc_id, text, row_number() OVER (PARTITION BY r.doc_id ORDER BY query_id) AS i FROM v_relevance r JOIN benchmark ON item_id = query_id)
        GROUP BY 1) e ON e.doc_id = n.case_id""")
def txt_19(spark, sf):
    lists = pm.evidence_lists(note_evidence(spark, sf))
    rows = fx.notes(spark, sf).join(lists, "case_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    return rows.select("case_id", F.md5(pm.ranked_prompt(F.col("context"), pm.numbered_block(F.col("texts")))).alias("digest"))


@query("txt_20", """SELECT p.case_id, rnk, concat('Candidate: "', p.label, '"', chr(10), 'Accepted:', chr(10), truths, chr(10),
    'Does the candidate mean the same as any accepted label? TRUE or FALSE.', chr(10), 'Verdict:') AS prompt FROM v_predictions p
    JOIN (SELECT case_id, string_agg('- ' || label, chr(10) ORDER BY label) AS truths FROM v_gold GROUP BY 1) USING (case_id)""")
def txt_20(spark, sf):
    return pm.judge_tasks(fx.predictions(spark, sf), fx.gold(spark, sf)).select("case_id", "rnk", "prompt")


@query("txt_20_pairs", """SELECT p.case_id, rnk, g.label AS gold_label, concat('Candidate: "', p.label, '"', chr(10), 'Accepted:', chr(10), '- ', g.label, chr(10),
    'Does the candidate mean the same as any accepted label? TRUE or FALSE.', chr(10), 'Verdict:') AS prompt FROM v_predictions p JOIN v_gold g USING (case_id)""")
def txt_20_pairs(spark, sf):
    """The pair form: one prompt per prediction and gold label; the pairs are what is asked for."""
    return pm.pair_tasks(fx.predictions(spark, sf), fx.gold(spark, sf)).select("case_id", "rnk", "gold_label", "prompt")


@query("udf_05", f"SELECT case_id, rnk, sentence_idx, round({OVERLAP}, 6) + 0.0 AS score FROM v_talk_pairs", PAIR)
def udf_05(spark, sf):
    return talk_pairs(spark, sf).select("case_id", "rnk", "sentence_idx", r6(sc.lexical_overlap(F.col("premise"), F.col("sentence")), "score"))


def _overlap_scorer():
    """A batch pair scorer for wiring: word overlap as entailment, the rest neutral."""
    import regex

    def score(pairs):
        out = []
        for premise, sentence in pairs:
            s = set(regex.findall(r"\w+", sentence.lower()))
            e = len(s & set(regex.findall(r"\w+", premise.lower()))) / len(s) if s else 0.0
            out.append((e, 1.0 - e, 0.0))
        return out
    return score


@query("udf_02", f"SELECT case_id, rnk, sentence_idx, round({OVERLAP}, 6) + 0.0 AS entailment FROM v_talk_pairs", PAIR)
def udf_02(spark, sf):
    scored = sc.score_pairs(talk_pairs(spark, sf), _overlap_scorer)
    return scored.select("case_id", "rnk", "sentence_idx", r6("entailment"))


@query("udf_01", r"""SELECT doc_id, length(text) AS n, length(text)::DOUBLE AS first, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS second FROM documents""")
def udf_01(spark, sf):
    def load():
        return lambda texts: [[len(t), t.count(" ")] for t in texts]
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    vectors = sc.embed(docs, load)
    return docs.join(vectors, "text").select("doc_id", F.length("text").alias("n"), F.get("vector", F.lit(0)).alias("first"),
                                             F.get("vector", F.lit(1)).alias("second"))


@query("udf_03", """SELECT p.case_id, p.rnk, g.label IS NOT NULL AS is_correct FROM v_predictions p LEFT JOIN v_gold g ON g.case_id = p.case_id AND g.label = p.label""")
def udf_03(spark, sf):
    """A judge that reads the prompt: true when the candidate is among the accepted labels."""
    def load():
        def answer(prompts):
            return [p.split('"')[1] in [x[2:] for x in p.split("\n") if x.startswith("- ")] for p in prompts]
        return answer
    predictions = fx.predictions(spark, sf)
    tasks = pm.judge_tasks(predictions, fx.gold(spark, sf)).select("case_id", "rnk", "prompt")
    every = predictions.select("case_id", "rnk").join(tasks, ["case_id", "rnk"], "left")
    return sc.judge(every, load).select("case_id", "rnk", "is_correct")


@query("udf_04", "SELECT case_id, section_idx, label, content, label IN ('Chief complaint', 'History of present illness') AS is_anchor FROM v_note_sections", SECTION_VIEWS)
def udf_04(spark, sf):
    from ..plans.domains import domain
    return domain("ranked").section_rows(fx.notes(spark, sf))


GRD5 = {**PAIR, "v_tp": f"""SELECT case_id, rnk, i - 1 AS sentence_idx, s[i] AS sentence, premise FROM (
        SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT case_id, rnk, context AS premise, list_filter(list_transform(
            string_split(regexp_replace(trim(reasoning, ' ' || chr(10)), '([.!?])[\\s\\p{{Z}}]+', '\\1' || chr(1), 'g'), chr(1)),
            lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS s FROM v_reasoning))""",
        "v_ts": f"SELECT case_id, rnk, sentence_idx, round({OVERLAP} - 0.5::DOUBLE, 9) + 0.0 AS score FROM v_tp"}


@query("grd_05", """SELECT case_id, rnk, round(arg_max(score, {'a': abs(score), 'b': -sentence_idx}), 6) + 0.0 AS g_max, round(avg(score), 6) + 0.0 AS g_avg,
    count(*) AS num_sentences, string_agg(score::DECIMAL(12,6)::VARCHAR, '|' ORDER BY sentence_idx) AS sentence_scores FROM v_ts GROUP BY 1, 2""", GRD5)
def grd_05(spark, sf):
    """MCQ grounding over the talk table: question as premise, any-case sentence split, overlap less a half as score."""
    from ..plans.jobs import mcq_grounding
    talk = fx.reasoning(spark, sf)
    premises = talk.select("case_id", "rnk", F.lit(0).alias("premise_idx"), F.col("context").alias("premise"))
    score = F.round(sc.lexical_overlap(F.col("premise"), F.col("sentence")) - 0.5, 9) + 0.0
    out = mcq_grounding(premises, talk, score)
    listed = F.array_join(F.transform("sentence_scores", lambda s: s.cast("decimal(12,6)").cast("string")), "|")
    return out.select("case_id", "rnk", r6("g_max"), r6("g_avg"), "num_sentences", listed.alias("sentence_scores"))


@query("grd_08", """SELECT r.query_id, r.doc_id, matched, CASE WHEN matched THEN round(score, 6) + 0.0 ELSE 0.0::DOUBLE END AS reward FROM (
    SELECT query_id, doc_id, query_id % 2 = 0 AS matched FROM v_relevance) r JOIN v_scored USING (query_id, doc_id)""", RET)
def grd_08(spark, sf):
    from ..operators.retrieval import align
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    rows = align(corpus(spark, sf), items, fx.relevance(spark, sf)).withColumn("matched", F.col("query_id") % 2 == 0)
    return rows.select("query_id", "doc_id", "matched", r6(gr.gated_alignment(F.col("score"), F.col("matched")), "reward"))


@query("grd_09", """SELECT case_id, count(*) AS n_sections, max(CASE WHEN label = 'Chief complaint' THEN length(content) END) AS chief_length
    FROM v_note_sections GROUP BY 1""", SECTION_VIEWS)
def grd_09(spark, sf):
    """Sections parsed once per case, kept as a table, and read by every consumer."""
    from ..session import materialised
    rows = materialised(note_sections(spark, sf), "sections").select("case_id", F.explode("sections").alias("s"))
    return rows.groupBy("case_id").agg(
        F.count("*").alias("n_sections"),
        F.max(F.when(F.col("s.label") == "Chief complaint", F.length("s.content"))).alias("chief_length"))
