"""Queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import alignment, bpe, chat, classifier, codes, mixing, neardup, neighbours, quality, suffixes, tokens, urls, warc
from .common import materialised, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


# Words as the operators take them.
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX_SQL = rf"""WITH sizes AS (SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, source_size * 3 AS cap, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM per_source),
filled AS (SELECT *, cap::DOUBLE / weight AS fill FROM ranked),
levels AS (SELECT *, ((SELECT sum(source_size) FROM per_source) - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
targets AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(cap::DOUBLE, (SELECT arg_min(level, fill) FROM levels WHERE level <= fill) * weight) ELSE 0.0::DOUBLE END AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT
    + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source"""


@query("op1_mixing", MIX_SQL)
def op1_mixing(spark, sf):
    sizes = materialised(table(spark, sf, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")), "sizes")
    mixed = mixing.with_copies(sizes, mixing.source_rates(sizes), digest=F.col("digest"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


RULES_SQL = r"""WITH base AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS r FROM documents),
windows AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM base),
marked AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
covered AS (SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM marked WHERE n > 1) GROUP BY r),
counts AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM base LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS soft_failed FROM counts),
hosts AS (SELECT source AS host, count(*) AS n, sum((base_failed OR soft_failed)::BIGINT)::BIGINT AS failures FROM judged GROUP BY source),
whole AS (SELECT sum(n)::DOUBLE AS all_n, sum(failures)::DOUBLE / sum(n) AS m, sum(n * (failures / n) * (failures / n)) / sum(n) AS squares FROM hosts),
prior AS (SELECT m, all_n, CASE WHEN squares - m * m > 0 THEN least(greatest(m * (1 - m) / (squares - m * m) - 1, 0), all_n) ELSE all_n END AS strength FROM whole),
verdicts AS (SELECT host, (failures + strength * m) / (n + strength) > 0.5 AS host_failed FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (host_failed AND soft_failed) AS kept
FROM judged JOIN verdicts ON source IS NOT DISTINCT FROM host"""


@query("op6_quality_rules", RULES_SQL)
def op6_quality_rules(spark, sf):
    judged = quality.measured(table(spark, sf, "documents").select("doc_id", "source", "text")).drop("text")
    return quality.with_verdicts(judged).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# A conversation whose texts hold the control strings of another template.
CONTROL = "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') t(conv_id, turn, role, text)"

CHAT_SQL = r"""WITH talk AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
forms AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\') AS erole, replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') AS etext FROM talk)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(erole) + length(etext) + 23)::BIGINT AS formatted_chars
FROM forms GROUP BY conv_id"""


@query("op9_chat_format", CHAT_SQL)
def op9_chat_format(spark, sf):
    talk = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL))
    read = chat.read_back(chat.formatted(materialised(chat.reply_rows(talk), "messages")))
    digest = lambda parts: F.sha2(F.array_join(parts, "").cast("binary"), 256)
    return read.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        digest(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns_sha256"),
        F.aggregate("learnt", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("loss_chars"),
        digest(F.col("learnt")).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op8_token_counts")
def op8_token_counts(spark, sf):
    return tokens.token_counts(table(spark, sf, "documents"))


@query("op10_bpe")
def op10_bpe(spark, sf):
    return bpe.digests(table(spark, sf, "documents"))


@query("op2_one_bit_codes")
def op2_one_bit_codes(spark, sf):
    indexed = materialised(neighbours.index(table(spark, sf, "embeddings")), "codes")
    return neighbours.search(indexed, indexed.filter("vec_id % 50 = 0"), 5)


WARC_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first, count(*) AS n FROM p WHERE octet_length(payload) >= 100 GROUP BY d HAVING count(*) > 1)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, p.d AS payload_digest,
    CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f ON p.d = f.d"""


@query("op5_warc", WARC_SQL)
def op5_warc(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"))


@query("op3_url_trees")
def op3_url_trees(spark, sf):
    return urls.judged(table(spark, sf, "pages").select("page_id", "url"))


@query("op4_neardup")
def op4_neardup(spark, sf):
    return neardup.deduped(table(spark, sf, "documents"))


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark, sf):
    return suffixes.removed(table(spark, sf, "documents").select("doc_id", "text"))


@query("op11_alignment")
def op11_alignment(spark, sf):
    return alignment.summaries(table(spark, sf, "documents"))


@query("op12_vector_codes")
def op12_vector_codes(spark, sf):
    coded, books = codes.compressed(table(spark, sf, "embeddings"))
    return codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


@query("op13_quality_classifier")
def op13_quality_classifier(spark, sf):
    return classifier.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
