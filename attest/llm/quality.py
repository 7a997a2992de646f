"""Quality rules per document and per host.

Base rules judge a text alone. Failures of all rules are then aggregated per host, the rates are shrunk
with a beta prior fitted to the hosts, and the verdict on a host is joined back: in a host that mostly fails,
a document with a soft failure goes too. A document that fails no rule is kept whatever its host.

Defined results: null and empty texts have no words and fail the base; a null host is a host of its own;
repeated rows are judged and counted each; an empty table gives an empty result; columns of other names
pass through, columns that bear a name the operator adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, let, materialised, words

MIN_WORDS = 50
REPEAT_PERCENT = 50
# Soft rules: symbols per word, repeated lines per line with a word, code points per word.
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
WORD_LENGTHS = (3, 10)
# A host fails if its shrunk rate of failing documents is above this.
HOST_RATE = 0.5
ADDED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(w: Column, window: int = 3) -> Column:
    """Words inside a window of ``window`` words that is found twice or more in the text.

    The hashes of the windows are sorted inside the row (96 bits and the place); equal neighbours are
    repeats, and the places, in order, cover at most ``window`` words each."""
    n = F.size(w)
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))), lambda i: i <= n - window)

    def key(i):
        parts = [F.get(w, i + k) for k in range(window)]
        return F.struct(F.xxhash64(*parts).alias("a"), F.hash(*parts).alias("b"), i.alias("i"))

    def repeated(s):
        def same(x, y):
            return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))
        return F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1))), lambda x: x["i"])

    found = let(F.sort_array(F.transform(places, key)), lambda s: F.sort_array(repeated(s)))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("covered"))
    return F.aggregate(
        found, start,
        lambda acc, i: F.struct(i.alias("last"), (acc["covered"] + F.least(F.lit(window), i - acc["last"])).alias("covered")),
        lambda acc: acc["covered"]).cast("bigint")


def base_columns(text: Column) -> Column:
    """A struct of the counts of one text."""
    filled = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(filled, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
        (F.length(filled) - F.length(F.translate(filled, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        line_counts["n"].cast("bigint").alias("n_lines"),
        line_counts["dup"].cast("bigint").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def soft_failed() -> Column:
    low, high = WORD_LENGTHS
    return ((100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("n_words"))
            | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"))
            | (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words")))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts, base_failed and soft_failed."""
    counts = fresh("counts", *docs.columns)
    counted = docs.drop(*ADDED, "base_failed", "soft_failed").withColumn(counts, base_columns(F.col(text)))
    spread = counted.select("*", *[F.col(counts)[c].alias(c) for c in ADDED]).drop(counts)
    return spread.withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed())


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """(host, n, failures, rate): the failing share per host, shrunk to the mean of all hosts.

    The prior is a beta distribution by moments: mean m, and m(1-m)/v - 1 pseudo documents, where v is the
    variance of the rates between hosts. Hosts that do not differ have an unbounded prior; it is held at
    the number of documents of all hosts."""
    per_host = judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("bigint")).alias("failures"))
    p = F.col("failures") / F.col("n")
    whole = per_host.agg(F.sum("n").alias("all_n"), F.sum("failures").alias("all_failures"), F.sum(F.col("n") * p * p).alias("squares"))
    m = F.col("all_failures") / F.col("all_n")
    v = F.greatest(F.col("squares") / F.col("all_n") - m * m, F.lit(0.0))
    strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(0.0)), F.col("all_n").cast("double"))).otherwise(F.col("all_n").cast("double"))
    # One row of totals beside the hosts.
    return per_host.join(F.broadcast(whole.select(m.alias("mean"), strength.alias("strength"))), F.lit(True)).select(
        "host", "n", "failures", ((F.col("failures") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))).alias("rate"))


def judged_with_hosts(judged: DataFrame, rates: DataFrame, host: str = "source") -> DataFrame:
    """``judged`` with host_failed and kept."""
    of = fresh("of_host", *judged.columns)
    verdicts = rates.select(F.col("host").alias(of), (F.col("rate") > HOST_RATE).alias("host_failed"))
    joined = judged.drop("host_failed", "kept").join(verdicts, F.col(host).eqNullSafe(F.col(of)), "left").drop(of)
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.coalesce("host_failed", F.lit(False)) & F.col("soft_failed")))


def with_verdicts(judged: DataFrame, host: str = "source") -> DataFrame:
    """Measured documents with host_failed and kept. The counts are the dear part, so they are written once to the
    shared folder, with the other columns of ``judged``."""
    written = materialised(judged, "rules")
    # The short list of hosts is written, so that Spark knows its size before it plans the join with the texts.
    rates = materialised(host_rates(written.select(host, "base_failed", "soft_failed"), host), "host-rates")
    return judged_with_hosts(written, rates, host)


def rules(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` with counts and verdicts."""
    return with_verdicts(measured(docs, text), host)


def kept(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The kept documents with their own columns."""
    return rules(docs, text, host).filter("kept").select(*docs.columns)
