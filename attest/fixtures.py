"""Views that bind the operators to the driver's tables (see FIXTURES.md, part B).

``SQL`` holds the same views for the comparison engine; both sides give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .functions.text import let

# Sentences from this length on meet a text's sentences on their last characters, shorter ones on all of theirs.
TAIL = 20
BROADCAST_NEEDLES = 200_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def portable_hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def cases(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderpriority").alias("model"),
        F.when(status == "F", "baseline").when(status == "O", "rag").otherwise("tuned").alias("cond"),
    )


def predictions(spark, sf):
    order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    base = (F.col("l_quantity") - 25.5) / 24.5
    ranked = (
        table(spark, sf, "lineitem")
        .filter("l_returnflag <> 'N'")
        .withColumn("rnk", F.row_number().over(order))
        .select(
            F.col("l_orderkey").alias("case_id"), "rnk", "l_partkey",
            (F.round(base, 6) + 0.0).alias("g_max"),
            (F.round(base * (1 - F.col("l_discount")), 6) + 0.0).alias("g_avg"),
        )
    )
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("label"))
    return ranked.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "case_id", "rnk", "label", "g_max", "g_avg")


def gold(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("label"))
    return (
        table(spark, sf, "lineitem").filter("l_linestatus = 'F'")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("case_id"), "label").distinct()
    )


def nli_scores(spark, sf):
    grid = (
        predictions(spark, sf).select("case_id", "rnk")
        .withColumn("sentence_idx", F.explode(F.sequence(F.lit(0), F.col("rnk") % 3)))
        .withColumn("premise_idx", F.explode(F.sequence(F.lit(0), F.lit(2))))
    )
    key = ["case_id", "rnk", "sentence_idx", "premise_idx"]
    e = portable_hash(F.concat_ws(":", *key)) % 1001 / 1000.0
    u = portable_hash(F.concat_ws("/", *key)) % 1001 / 1000.0
    return grid.select(
        *key, e.alias("entailment"),
        F.round((1 - e) * u, 6).alias("contradiction"),
        F.round((1 - e) * (1 - u), 6).alias("neutral"),
    )


def votes(spark, sf):
    sample = (F.col("l_suppkey") % 5).cast("int")
    order = W.partitionBy("l_orderkey", "sample_idx").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    ranked = (
        table(spark, sf, "lineitem").withColumn("sample_idx", sample)
        .withColumn("position", F.row_number().over(order) - 1)
        .select(F.col("l_orderkey").alias("case_id"), "sample_idx", "position", "l_partkey")
    )
    part = table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("label"), F.col("p_name").alias("reasoning"))
    return ranked.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "case_id", "sample_idx", "position", "label", "reasoning")


def relevance(spark, sf):
    """Documents that contain a sentence of a benchmark item, whichever of its sentences it is.

    A sentence is a run of non-dot characters and its dot, so a text holds it exactly where one of the text's
    own runs ends with it. A sentence of ``TAIL`` characters or more is an equi-join on the last of them, then a test. A shorter one
    equals a run's ending of its own length; there are fewer than ``TAIL`` lengths, and a text's endings are made
    distinct inside its row, so a text that repeats one sends it once."""
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[^.]+[.]"), F.lit(0)))).alias("needle"))
    # Splitting at the dots is linear; matching runs would rescan a text that has none.
    pieces = let(F.split("text", r"\."), lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: F.concat(x, F.lit("."))))
    docs = table(spark, sf, "documents").select("doc_id", F.array_distinct(pieces).alias("runs"))
    tail = lambda c: F.right(c, F.lit(TAIL))
    long = docs.select("doc_id", F.explode(F.filter("runs", lambda x: F.length(x) >= TAIL)).alias("run")).withColumn("tail", tail(F.col("run")))
    found = long.join(items.filter(F.length("needle") >= TAIL).withColumn("tail", tail(F.col("needle"))), "tail").filter(F.endswith("run", "needle"))
    short = items.filter(F.length("needle") < TAIL)
    sizes = {r[0]: r[1] for r in short.groupBy(F.length("needle")).count().collect()}
    lengths = sorted(sizes)
    # Up to a counted size they go to the texts, so that endings nobody asks for are not shuffled.
    short = F.broadcast(short) if sum(sizes.values()) <= BROADCAST_NEEDLES else short
    found = found.select("query_id", "doc_id")
    if lengths:
        # The last characters are cut off and made distinct first: a length is counted from a string's start.
        lasts = F.array_distinct(F.transform("runs", lambda x: F.right(x, F.lit(lengths[-1]))))
        ends = F.flatten(F.transform(lasts, lambda x: F.transform(
            F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(x)), lambda n: F.right(x, n))))
        endings = docs.select("doc_id", F.explode(F.array_distinct(ends)).alias("needle"))
        found = found.unionByName(endings.join(short, "needle").select("query_id", "doc_id"))
    return found.distinct()


def attempts(spark, sf):
    p, n = F.col("props"), F.col("event_id") % 8
    nested = F.concat(F.lit('{"diagnoses": [{"name": "'), "event_type", F.lit('", "reasoning": "r"}]}'))
    raw = (
        F.when(n == 0, "").when(n == 1, F.expr("substr(props, 1, length(props) - 1)"))
        .when(n == 2, F.concat(F.lit("Here is the output: "), p)).when(n == 3, F.concat(p, F.lit("]")))
        .when(n == 4, nested).otherwise(p)
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("subject_id"), raw.alias("raw_output"), (n >= 4).alias("success"))


def judgements(spark, sf):
    ident = F.col("event_id").cast("string")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("judgement_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").isin("click", "purchase").alias("verdict"),
        (portable_hash(F.concat(ident, F.lit(":g"))) % 3 > 0).alias("gold"),
        (portable_hash(F.concat(ident, F.lit(":c"))) % 11 / 10.0).alias("confidence"))


def reasoning(spark, sf):
    """The user turn before each assistant turn, and the assistant turn."""
    talk = table(spark, sf, "conversations")
    ask = talk.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    answer = talk.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reasoning"))
    return answer.join(ask, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("case_id"), F.expr("(turn + 1) div 2").alias("rnk"), "context", "reasoning")


def notes(spark, sf):
    t = F.translate("text", "\n", " ")
    nl = F.lit("\n")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("case_id"),
        F.concat(
            F.lit("note_id: "), F.col("doc_id").cast("string"), nl,
            F.lit("Chief complaint: "), F.substring(t, 1, 60), nl,
            F.lit("History of present illness: "), F.substr(t, F.lit(61)), nl,
            F.lit("ECG: "), F.col("lang"), nl,
            F.lit("ECG machine report: "), F.col("source"), F.lit("; "), F.col("source"), F.lit("; "), F.col("lang"), nl,
            F.lit("ECG machine report: "), F.col("lang"), F.lit("; "), F.col("lang")).alias("context"))


SQL = {
    "v_cases": """SELECT o_orderkey AS case_id, o_custkey AS subject_id, o_orderpriority AS model,
        CASE o_orderstatus WHEN 'F' THEN 'baseline' WHEN 'O' THEN 'rag' ELSE 'tuned' END AS cond FROM orders""",
    "v_predictions": """SELECT case_id, rnk, label, g_max, g_avg FROM (
        SELECT l_orderkey AS case_id, p_brand AS label,
            round((l_quantity - 25.5) / 24.5, 6) + 0.0 AS g_max,
            round((l_quantity - 25.5) / 24.5 * (1 - l_discount), 6) + 0.0 AS g_avg,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                l_extendedprice, l_quantity) AS rnk
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N')""",
    "v_gold": """SELECT DISTINCT l_orderkey AS case_id, p_brand AS label
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'""",
    "v_nli_base": """SELECT case_id, rnk, s AS sentence_idx, p AS premise_idx,
            (('0x' || substr(md5(case_id || ':' || rnk || ':' || s || ':' || p), 1, 8))::BIGINT % 1001) / 1000.0::DOUBLE AS e,
            (('0x' || substr(md5(case_id || '/' || rnk || '/' || s || '/' || p), 1, 8))::BIGINT % 1001) / 1000.0::DOUBLE AS u
        FROM v_predictions, range(3) a(s), range(3) b(p) WHERE s <= rnk % 3""",
    "v_nli_scores": """SELECT case_id, rnk, sentence_idx, premise_idx, e AS entailment,
            round((1 - e) * u, 6) AS contradiction, round((1 - e) * (1 - u), 6) AS neutral FROM v_nli_base""",
    "v_votes": """SELECT case_id, sample_idx, position, label, reasoning FROM (
        SELECT l_orderkey AS case_id, l_suppkey % 5 AS sample_idx, p_brand AS label, p_name AS reasoning,
            row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey,
                l_extendedprice, l_quantity) - 1 AS position
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "v_relevance": """SELECT DISTINCT item_id AS query_id, doc_id FROM
        (SELECT item_id, unnest(regexp_extract_all(text, '[^.]+[.]')) AS needle FROM benchmark) b
        JOIN documents d ON contains(d.text, needle)""",
    "v_attempts": """SELECT event_id AS attempt_id, ts, user_id AS subject_id,
        CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN substr(props, 1, length(props) - 1)
            WHEN 2 THEN concat('Here is the output: ', props) WHEN 3 THEN concat(props, ']')
            WHEN 4 THEN concat('{"diagnoses": [{"name": "', event_type, '", "reasoning": "r"}]}')
            ELSE props END AS raw_output, event_id % 8 >= 4 AS success FROM events""",
    "v_judgements": """SELECT event_id AS judgement_id, ts, event_type IN ('click', 'purchase') AS verdict,
        ('0x' || substr(md5(event_id || ':g'), 1, 8))::BIGINT % 3 > 0 AS gold,
        (('0x' || substr(md5(event_id || ':c'), 1, 8))::BIGINT % 11) / 10.0::DOUBLE AS confidence FROM events""",
    "v_reasoning": """SELECT a.conv_id AS case_id, (a.turn + 1) // 2 AS rnk, u.text AS context, a.text AS reasoning
        FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1
        WHERE a.role = 'assistant' AND u.role = 'user'""",
    "v_notes": """SELECT doc_id AS case_id, concat('note_id: ', cast(doc_id AS varchar), chr(10),
        'Chief complaint: ', substr(t, 1, 60), chr(10), 'History of present illness: ', substr(t, 61), chr(10),
        'ECG: ', lang, chr(10), 'ECG machine report: ', source, '; ', source, '; ', lang, chr(10),
        'ECG machine report: ', lang, '; ', lang) AS context
        FROM (SELECT *, replace(text, chr(10), ' ') AS t FROM documents)""",
}
