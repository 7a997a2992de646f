"""Structured-output queries (JSN, AGG-08..10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import repair as rp
from ..operators import extraction as ex
from ..session import materialised
from .metrics import ANSWER_VIEWS, answers
from .registry import query
from .shared import VIEWS, r6


# Parsing takes its time by the row, so the stored outputs are cut into files of so many.
FILE_ROWS = 20_000


def outputs(spark, sf):
    """Fixture model outputs: the ranked list of every case as JSON, spoilt in eight ways."""
    row = F.concat(F.lit('{"name": "'), "label", F.lit('", "reasoning": "seen at '), F.col("rnk"), F.lit(' in review"}'))
    lists = fx.predictions(spark, sf).groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("rnk", row.alias("j")))).alias("rows"))
    raw = F.concat(F.lit('{"diagnoses": ['), F.array_join(F.transform("rows", lambda r: r["j"]), ", "), F.lit("]}"))
    kind = F.col("case_id") % 8
    spoilt = (
        F.when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), raw, F.lit("\n```\nDone.")))
        .when(kind == 2, F.translate(raw, '"', "”"))
        .when(kind == 3, F.regexp_replace(raw, r'"(\w+)":', "'$1':"))
        .when(kind == 4, F.replace(raw, F.lit("]}"), F.lit(", ]}")))
        .when(kind == 5, F.replace(F.replace(F.replace(raw, F.lit('"diagnoses"'), F.lit('"Possible_Diagnosés"')),
                                             F.lit('"name"'), F.lit('"Title"')), F.lit('"reasoning"'), F.lit('"Rationale"')))
        .when(kind == 6, F.replace(raw, F.lit(" in review"), F.lit(' in "the" review')))
        .when(kind == 7, F.replace(raw, F.lit('review"}]'), F.lit("review}]"))).otherwise(raw))
    # Model outputs arrive as a stored table.
    return materialised(lists.select("case_id", F.lit(0).alias("sample_idx"), spoilt.alias("raw_output")), "outputs", FILE_ROWS)


OUTS = {**VIEWS, "v_items": """SELECT case_id, rnk, label, CASE case_id % 8 WHEN 6 THEN 'seen at ' || rnk || ' in "the" review'
    ELSE 'seen at ' || rnk || ' in review' END AS reasoning FROM v_predictions"""}


@query("jsn_01", """SELECT case_id, rnk, label, reasoning, n >= 3 AS parse_success FROM (
    SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM v_items) WHERE rnk <= 5""", OUTS)
def jsn_01(spark, sf):
    parsed = ex.parse_attempts(outputs(spark, sf))
    return ex.prediction_rows(parsed, ["case_id", "parse_success"]).select("case_id", "rnk", "label", "reasoning", "parse_success")


@query("jsn_02", """SELECT case_id, case_id % 8 > 1 AS repaired, 'diagnoses|' || repeat('name|reasoning|', count(*)) AS keys FROM v_items GROUP BY 1""", OUTS)
def jsn_02(spark, sf):
    """Keys of every output as it is read: those without a list to be read are repaired, the others stay."""
    rows = outputs(spark, sf).withColumn("fixed", rp.list_object(F.col("raw_output"))).withColumn(
        "repaired", F.coalesce(F.size(rp.listed_items(F.col("fixed"))), F.lit(-1)) <= 0)
    fixed = rp.repair_tail(rp.escape_inner_quotes(rp.repair_head(F.col("fixed"))))
    keys = F.regexp_extract_all(F.col("fixed"), F.lit(r'"(\w+)":'), F.lit(1))
    return rows.withColumn("fixed", F.when(F.col("repaired"), fixed).otherwise(F.col("fixed"))).select(
        "case_id", "repaired", F.when(rp.is_json(F.col("fixed")), F.concat(F.array_join(keys, "|"), F.lit("|"))).alias("keys"))


RAW = {**OUTS, "v_raw_output": """SELECT case_id, '{"diagnoses": [' || string_agg('{"name": "' || label || '", "reasoning": "seen at ' || rnk || ' in review"}', ', ' ORDER BY rnk) || ']}' AS raw
    FROM v_predictions GROUP BY 1"""}


@query("jsn_03", r"""SELECT case_id, CASE case_id % 8 WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || raw || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 2 THEN replace(raw, '"', '”') WHEN 3 THEN regexp_replace(raw, '"(\w+)":', '''\1'':', 'g') WHEN 4 THEN replace(raw, ']}', ', ]}')
    WHEN 6 THEN replace(raw, ' in review', ' in \"the\" review') ELSE replace(raw, 'review"}]', 'review}]') END AS fixed
    FROM v_raw_output WHERE case_id % 8 NOT IN (0, 5)""", RAW)
def jsn_03(spark, sf):
    """Every output that is not JSON with its inner quotes escaped; quotes that delimit stay as they are."""
    spoilt = outputs(spark, sf).filter(~rp.is_json(F.col("raw_output")))
    return spoilt.select("case_id", rp.escape_inner_quotes(F.col("raw_output")).alias("fixed"))


@query("jsn_04", """SELECT case_id, rnk, label, 'seen at ' || rnk || ' in review' AS reasoning FROM v_predictions WHERE case_id % 2 = 0 AND rnk <= 5
    UNION ALL SELECT * FROM (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY rnk), label, 'seen' FROM (
        SELECT case_id, label, min(rnk) AS rnk FROM v_predictions WHERE case_id % 2 = 1 AND rnk <= 5 GROUP BY 1, 2)) t(case_id, rnk, label, reasoning)""", OUTS)
def jsn_04(spark, sf):
    """Pattern fallback over cut-off objects (even cases) and numbered lists (odd cases)."""
    row = F.when(F.col("case_id") % 2 == 0, F.concat(
        F.lit("{'name': '"), "label", F.lit("', 'reasoning': 'seen at "), F.col("rnk"), F.lit(" in review'")))
    row = row.otherwise(F.concat(F.col("rnk"), F.lit(". "), "label", F.lit("\nseen")))
    lists = fx.predictions(spark, sf).groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("rnk", row.alias("j")))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["j"]), "\n}")
    even = lists.filter("case_id % 2 = 0").select("case_id", text.alias("raw_output"))
    odd = lists.filter("case_id % 2 = 1").select("case_id", F.array_join(F.transform("rows", lambda r: r["j"]), "\n").alias("raw_output"))
    rows = even.unionByName(odd).withColumn("items", rp.fallback_items(F.col("raw_output")))
    return ex.prediction_rows(rows, ["case_id"])


@query("jsn_05", """SELECT judgement_id, CASE judgement_id % 5 WHEN 4 THEN NULL ELSE substr('ABCD', (judgement_id % 4 + 1)::INT, 1) END AS answer FROM v_judgements""")
def jsn_05(spark, sf):
    n = F.col("judgement_id")
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (n % 4 + 1).cast("int"))
    js = F.concat(F.lit('{"answer": "'), F.lower(letter), F.lit('", "reasoning": "r"}'))
    text = (F.when(n % 5 == 0, js).when(n % 5 == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
            .when(n % 5 == 2, F.concat(F.lit("I think the correct answer is ("), letter, F.lit(").")))
            .when(n % 5 == 3, F.concat(letter, F.lit(", since"))).otherwise("No idea"))
    return fx.judgements(spark, sf).select("judgement_id", rp.mcq_answer(text)["answer"].alias("answer"))


@query("jsn_06", """SELECT attempt_id, raw_output LIKE '{"diagnoses%' AS parsed, CASE WHEN raw_output LIKE '{"diagnoses%' THEN 1 ELSE -1 END AS n,
    false AS valid FROM v_attempts""")
def jsn_06(spark, sf):
    items = rp.strict_items(F.col("raw_output"))
    n = F.coalesce(F.size(items), F.lit(-1))
    return fx.attempts(spark, sf).select(
        "attempt_id", items.isNotNull().alias("parsed"), n.alias("n"), (n == 5).alias("valid"))


@query("jsn_07", """SELECT case_id, rnk, label, reasoning FROM v_items WHERE case_id % 8 <> 6 AND rnk <= 5
    UNION ALL SELECT case_id, rnk, label, 'seen at ' || rnk || ' in review' FROM v_items WHERE case_id % 8 = 6 AND rnk <= 5""", OUTS)
def jsn_07(spark, sf):
    """Bare lists, some without their opening bracket, with text after the closing one."""
    row = F.concat(F.lit('{"diagnosis": "'), "label", F.lit('", "explanation": "seen at '), F.col("rnk"), F.lit(' in review"}'))
    lists = fx.predictions(spark, sf).groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("rnk", row.alias("j")))).alias("rows"))
    text = F.concat(F.when(F.col("case_id") % 2 == 0, "[").otherwise(""), F.array_join(F.transform("rows", lambda r: r["j"]), ", "),
                    F.lit("] and more [x]"))
    return ex.prediction_rows(lists.withColumn("items", rp.array_items(text)), ["case_id"])


CRITIQUES = {**VIEWS, "v_critiques": """SELECT case_id, rnk - 1 AS critique_idx, label, CASE WHEN g_max > 0 THEN 'HIGH' ELSE 'LOW' END AS confidence,
    CASE WHEN case_id % 3 = 2 THEN true ELSE g_max <= 0.5::DOUBLE END AS needs_evidence FROM v_predictions"""}


def critique_outputs(spark, sf):
    """Fixture critiques: confidence from the score; some with odd spellings, trailing commas or
    no evidence flag."""
    need = F.when(F.col("g_max") <= 0.5, "yes").otherwise("no")
    flag = F.when(F.col("case_id") % 3 == 2, "").otherwise(F.concat(F.lit(', "needs_evidence": "'), need, F.lit('"')))
    row = F.concat(F.lit('{"diagnosis": "'), "label", F.lit('", "confidence": "'),
                   F.when(F.col("g_max") > 0, "high").otherwise("unsure"), F.lit('"'), flag, F.lit("}"))
    lists = fx.predictions(spark, sf).groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("rnk", row.alias("j")))).alias("rows"))
    end = F.when(F.col("case_id") % 2 == 0, "]} thanks").otherwise(",]}")
    return materialised(lists.select("case_id", F.concat(F.lit('Sure: {"critiques": ['), F.array_join(
        F.transform("rows", lambda r: r["j"]), ", "), end).alias("raw_output")), "critique-outputs", FILE_ROWS)


def critiques(spark, sf):
    parsed = ex.parse_critiques(critique_outputs(spark, sf))
    return parsed.select("case_id", F.posexplode_outer("critiques").alias("critique_idx", "c")).filter("c is not null").select(
        "case_id", "critique_idx", "c.label", "c.confidence", "c.needs_evidence")


@query("jsn_08", "SELECT * FROM v_critiques", CRITIQUES)
def jsn_08(spark, sf):
    return critiques(spark, sf)


@query("jsn_09", """SELECT case_id, n >= 3 AS parse_success, n >= 3 AND case_id % 2 = 1 AS rescued, CASE WHEN n >= 3 THEN '' ELSE err END AS parse_error FROM (
    SELECT case_id, count(*) AS n, CASE WHEN case_id % 2 = 1 THEN 'JSON parse error' ELSE 'Only ' || count(*) || '/5 complete diagnoses parsed' END AS err
    FROM v_predictions GROUP BY 1)""", VIEWS)
def jsn_09(spark, sf):
    """Odd cases fail to parse at first; a second extraction of the same list is merged in."""
    good = outputs(spark, sf)
    first = good.withColumn("raw_output", F.when(F.col("case_id") % 2 == 1, "no list").otherwise(F.col("raw_output")))
    second = ex.parse_attempts(good).filter("case_id % 2 = 1")
    return ex.rescue(ex.parse_attempts(first), second, ["case_id", "sample_idx"]).select(
        "case_id", "parse_success", "rescued", "parse_error")


ERRORS = {"v_errors": """SELECT attempt_id, ts, raw_output, CASE attempt_id % 8 WHEN 0 THEN 'empty_output' WHEN 1 THEN 'incomplete_json'
    WHEN 2 THEN 'extra_text' WHEN 3 THEN 'incomplete_json' END AS error_type FROM v_attempts WHERE NOT success"""}


def failures(spark, sf):
    message = F.lit(None).cast("string")
    return fx.attempts(spark, sf).filter(~F.col("success")).withColumn("error_type", rp.error_class(F.col("raw_output"), message))


@query("jsn_10", """SELECT attempt_id, error_type, CASE attempt_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'appears_truncated|unmatched_braces'
    WHEN 2 THEN 'appears_truncated|extra_text_before' ELSE 'appears_truncated|unmatched_brackets' END AS patterns FROM v_errors""", ERRORS)
def jsn_10(spark, sf):
    return failures(spark, sf).select("attempt_id", "error_type", F.array_join(rp.error_patterns(F.col("raw_output")), "|").alias("patterns"))


@query("jsn_11", """SELECT case_id, answer IS NOT NULL AS parse_success, CASE WHEN answer IS NULL THEN NULL WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy,
    correct FROM v_answers""", ANSWER_VIEWS)
def jsn_11(spark, sf):
    rows = answers(spark, sf)
    return ex.match_records(rows.select("case_id", "answer"), rows).select("case_id", "parse_success", "accuracy", "correct")


def summary(spark, sf):
    total = fx.attempts(spark, sf).agg(F.count("*").alias("total"))
    return ex.error_summary(failures(spark, sf), total)


@query("agg_08", """SELECT error_type, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM v_errors), 6) + 0.0 AS share,
    round((SELECT count(*) FROM v_errors)::DOUBLE / (SELECT count(*) FROM v_attempts), 6) + 0.0 AS failure_rate FROM v_errors GROUP BY 1""", ERRORS)
def agg_08(spark, sf):
    return summary(spark, sf).select("error_type", "n", r6("share"), r6("failure_rate"))


@query("agg_09", """SELECT error_type, example, attempt_id, substr(raw_output, 1, 500) AS preview FROM (SELECT *, row_number() OVER (
    PARTITION BY error_type ORDER BY attempt_id) AS example FROM v_errors) WHERE example <= 3""", ERRORS)
def agg_09(spark, sf):
    return ex.error_examples(failures(spark, sf), 3)


@query("agg_10", """SELECT 'State the JSON structure; the output may hit its token limit.' AS message WHERE
        (SELECT avg((error_type = 'incomplete_json')::INT) FROM v_errors) > 0.2
    UNION ALL SELECT 'Ask for the JSON only.' WHERE (SELECT avg((error_type = 'extra_text')::INT) FROM v_errors) > 0.1
    UNION ALL SELECT 'Check generation for silent failures.' WHERE (SELECT avg((error_type = 'empty_output')::INT) FROM v_errors) > 0.05""", ERRORS)
def agg_10(spark, sf):
    return ex.recommendations(summary(spark, sf))
