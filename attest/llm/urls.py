"""URL filters: rules where one fits, else boosted trees on lexical features, trained from the urls that rules label.

Features: lengths, depth, digit ratio, entropy of the letters, parameter and label counts, and for the last label
and the last two labels of the host and for the first segment of the path the smoothed share of blocked urls among the
labelled ones. The trees are fitted on at most TRAIN_ROWS distinct labelled urls, half of them per label, those of smallest
hash; they weigh as much as they have copies, scaled so that a label weighs what all its rows do. The shares count all
labelled rows; a url that is learnt from has the shares of the other folds of hosts alone, so that the trees don't see its
own label, or its host's, in them.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by its
features; repeated rows are judged alike; without labelled urls every other url is allowed; if all labels agree,
that label is the method's verdict; an empty table gives an empty result; other columns pass through, and those
that bear a name the operator adds are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, let, lower_ascii, materialised

# (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
TRAIN_ROWS = 20_000
SMOOTHING = 20.0
FEATURES = ("f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_suffix", "f_domain", "f_segment")
SUFFIXES = ("suffix", "domain", "segment")
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return lower_ascii(part(r"(?s)\A.*?://([^/?#]*)")), part(r"(?s)\A.*?://[^/?#]*([^?#]*)")


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path and the longest rule that fits (rule, rule_verdict; null without one)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit(start))
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return parsed.withColumns({"rule": rule, "rule_verdict": verdict})


def entropy(text: Column) -> Column:
    """Bits per letter of the letters' own distribution."""
    def of(letters):
        share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters)
        return F.aggregate(F.transform(F.array_distinct(letters), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.coalesce(let(F.filter(F.split(text, ""), lambda x: x != ""), of), F.lit(0.0))


def features(parsed: DataFrame) -> DataFrame:
    """Adds the lexical features, the two suffixes of the host and the first segment of the path."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return parsed.withColumns({
        "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
        "segment": F.substring_index(F.substring("path", 2, 1 << 30), "/", 1),
        "f_length": F.length(url).cast("double"), "f_host_length": F.length("host").cast("double"),
        "f_depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "f_labels": F.size(F.split("host", r"\.")).cast("double"),
        "f_digits": F.coalesce(F.regexp_count(url, F.lit("[0-9]")) / F.nullif(F.length(url), F.lit(0)), F.lit(0.0)),
        "f_entropy": entropy(url),
        "f_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double")})


def counted(labelled: DataFrame, key: str) -> DataFrame:
    """(key, fold, blocked, n): labelled rows per suffix and fold of hosts."""
    blocked = F.sum(F.when(F.col("rule_verdict") == "block", F.col("copies")).otherwise(0.0))
    return labelled.groupBy(key, "fold").agg(blocked.alias("blocked"), F.sum("copies").alias("n"))


def share(blocked: Column, n: Column) -> Column:
    """Drawn towards one half."""
    return (blocked + SMOOTHING / 2) / (n + SMOOTHING)


def whole_shares(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key).agg(share(F.sum("blocked"), F.sum("n")).alias(f"f_{key}"))


def outer_shares(counts: DataFrame, key: str) -> DataFrame:
    """(key, fold, share): the share over the other folds."""
    whole = counts.groupBy(key).agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"))
    return counts.join(whole, key).select(key, "fold", share(F.col("all_blocked") - F.col("blocked"), F.col("all_n") - F.col("n")).alias(f"f_{key}"))


def with_shares(frame: DataFrame, shares: dict[str, DataFrame], *on: str) -> DataFrame:
    for key, table in shares.items():
        frame = frame.join(table, [key, *on], "left").withColumn(f"f_{key}", F.coalesce(f"f_{key}", F.lit(0.5)))
    return frame


def weights_of(rows: DataFrame) -> dict[float, float]:
    """{label: copies} of a table of labelled urls."""
    return {r.label: r.n for r in rows.groupBy("label").agg(F.sum("copies").alias("n")).collect()}


def labelled_urls(parsed: DataFrame) -> DataFrame:
    """The distinct urls that a rule decides, with their copies, label, fold and features."""
    distinct = materialised(parsed.filter("rule is not null").groupBy("url", "host", "path", "rule_verdict").agg(
        F.count(F.lit(1)).cast("double").alias("copies")), "labelled-urls")
    return features(distinct).withColumn("label", (F.col("rule_verdict") == "block").cast("double")).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))


class Filter:
    """Shares and trees fitted on labelled urls; a constant where there are no two labels."""

    def __init__(self, labelled: DataFrame, train_rows: int = TRAIN_ROWS):
        counts = {key: materialised(counted(labelled, key), "suffix-counts") for key in SUFFIXES}
        self.shares = {key: materialised(whole_shares(counts[key], key), "suffixes") for key in SUFFIXES}
        learnt = with_shares(labelled, {key: materialised(outer_shares(counts[key], key), "outer-suffixes") for key in SUFFIXES}, "fold")
        # At most ``train_rows`` urls, in one order in one file, so that the fit doesn't depend on the partitioning.
        half = lambda label: learnt.filter(F.col("label") == label).select("label", "copies", *FEATURES, F.xxhash64("url").alias("place")).orderBy(
            "place", *FEATURES).limit(max(1, train_rows // 2)).drop("place")
        sample = materialised(half(0.0).unionByName(half(1.0)).coalesce(1), "url-sample")
        whole, part = weights_of(labelled), weights_of(sample)
        self.constant = None if len(whole) == 2 else next(iter(whole), 0.0)
        if self.constant is None:
            trees = GBTClassifier(featuresCol="url_features", labelCol="label", weightCol="weight", maxDepth=3, maxIter=10, stepSize=0.3, seed=7)
            scale = F.when(F.col("label") == 1, whole[1.0] / part[1.0]).otherwise(whole[0.0] / part[0.0])
            vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="url_features")
            self.model = trees.fit(vectors.transform(sample.withColumn("weight", F.col("copies") * scale)))

    def applied(self, featured: DataFrame, blocked: str, chance: str = "") -> DataFrame:
        """``featured`` with the column ``blocked`` (1 or 0) and, if it is named, the chance of 1 as a vector with that of 0."""
        frame = with_shares(featured, self.shares)
        if self.constant is not None:
            return frame.withColumn(blocked, F.lit(self.constant))
        vector = fresh("url_features", *frame.columns)
        model = self.model.copy().setFeaturesCol(vector).setPredictionCol(blocked).setRawPredictionCol("").setProbabilityCol(chance)
        return model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol=vector).transform(frame)).drop(vector)


def judged(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "rule_verdict", "verdict", *FEATURES, *SUFFIXES)]
    parsed = ruled(pages.select(*own), rules)
    blocked = fresh("blocked", *parsed.columns)
    frame = Filter(labelled_urls(parsed), train_rows).applied(features(parsed), blocked)
    verdict = F.coalesce("rule_verdict", F.when(F.col(blocked) == 1, "block").otherwise("allow"))
    return frame.select(*own, "host", "path", "rule", verdict.alias("verdict"))
