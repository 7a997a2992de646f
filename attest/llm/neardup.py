"""Near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles, as 64-bit hashes; its sketch is the SKETCH smallest. Documents
of equal sets are one class from the start. Inverted lists of the retained values give candidates, the union of
two sketches estimates their similarity, and pairs that may reach the threshold are confirmed on full sets.

The threshold is ``percent``, 85 unless the caller names another. A pair at the threshold shares at least shared(percent)
of the values in the union's sketch (by the binomial law at most MISSED of such pairs share fewer: one in 280,000 at 85,
one in 840,000 at 80; sets of up to exact(percent), 27 and 25, are exact). So, with a document's values ordered by the
length of their lists, two such documents meet in the lists of their len - shared(percent) + 1 rarest values: passages
that many documents share fall outside, and most documents have no candidate at all.

Lists up to SHORT give their pairs. In a longer one, every member is first compared with the member that shares most
of its values (the copied text rather than a copy), and what that links counts as one component. Members of
different components are then looked up again by full sets: rarest shingles first, counting only shingles that two of
these documents have, and a pair is compared only where the places of a common shingle leave enough behind it.

Defined results: null and empty texts have an empty set and no links; rows without an id have no links and are kept;
rows that share an id are one node; repeated rows get the same result each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import release_since, scratch
from .common import let, lower_ascii, materialised, words
from .components import components

WORDS = 5
PERCENT = 85
SKETCH = 32
# Share of the pairs at the threshold that may fall below ``shared``.
MISSED = 4e-6
SHORT = 64


def exact(percent: int) -> int:
    """Up to this size a set and every set that is similar enough fit their sketches."""
    return SKETCH * percent // 100


def shared(percent: int) -> int:
    """The most values of a union's sketch that all but MISSED of the pairs at the threshold share."""
    p, fewer = percent / 100, 0.0
    for n in range(SKETCH + 1):
        fewer += comb(SKETCH, n) * p ** n * (1 - p) ** (SKETCH - n)
        if fewer > MISSED:
            return n
    return SKETCH


def shingles(text: Column) -> Column:
    """Distinct hashes of the five-word shingles; of the whole sequence if it is shorter."""
    return let(words(lower_ascii(text)), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))),
                                     lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])))))


def least_shared(n: Column, percent: int) -> Column:
    return F.when(n <= exact(percent), F.ceil(n * percent / 100)).otherwise(F.lit(shared(percent))).cast("int")


def similar_sizes(a: str, b: str, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, hi, lo, sketch): the size, two hashes of the whole set, and the sketch of every row."""
    digest = lambda s: F.struct(F.size(s).cast("bigint").alias("n_shingles"), F.xxhash64(s).alias("hi"), F.xxhash64(F.lit(7), s).alias("lo"), F.slice(s, 1, SKETCH).alias("sketch"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), let(F.sort_array(shingles(F.col(text))), digest).alias("s"))
    return rows.select("doc_id", "s.*")


def classes(sketches: DataFrame) -> DataFrame:
    """(class_id, n, hi, lo, sketch): one row per distinct non-empty set, named by its smallest document."""
    return sketches.filter("doc_id is not null and n_shingles > 0").groupBy("hi", "lo", "n_shingles").agg(
        F.min("doc_id").alias("class_id"), F.first("sketch").alias("sketch")).withColumnRenamed("n_shingles", "n")


def rare_postings(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(v, class_id, n, m, size): the rarest retained values of each class, with the number ``m`` of its values that other
    classes retain too and the size of the value's list among these postings."""
    postings = sets.select("class_id", "n", F.explode("sketch").alias("v"))
    lists = materialised(postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "lists")
    common = postings.join(lists, "v").groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    room = F.size("vs") - least_shared(F.col("n"), percent) + 1
    rare = materialised(
        common.filter(room > 0).select("class_id", "n", F.size("vs").alias("m"), F.explode(F.slice("vs", F.lit(1), room)).alias("x"))
        .select("class_id", "n", "m", F.col("x.v").alias("v")), "postings")
    sizes = rare.groupBy("v").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rare.join(materialised(sizes, "list-sizes"), "v")


def short_pairs(postings: DataFrame, limit: int = SHORT, percent: int = PERCENT) -> DataFrame:
    """(a, b): all pairs of lists that hold at most ``limit`` members."""
    short = postings.filter(F.col("size") <= limit)
    left = short.select("v", F.col("class_id").alias("a"), F.col("n").alias("na"))
    right = short.select("v", F.col("class_id").alias("b"), F.col("n").alias("nb"))
    return left.join(right, "v").filter("a < b").filter(similar_sizes("na", "nb", percent)).select("a", "b").distinct()


def star_pairs(postings: DataFrame, limit: int = SHORT, percent: int = PERCENT) -> DataFrame:
    """(a, b): in every longer list the member with most shared values beside each other one."""
    long = postings.filter(F.col("size") > limit)
    middle = long.groupBy("v").agg(F.max_by(F.struct(F.col("class_id").alias("c"), F.col("n").alias("nc")), F.struct("m", -F.col("class_id"))).alias("p")).select("v", "p.*")
    return long.join(middle, "v").filter("class_id <> c").filter(similar_sizes("n", "nc", percent)).select(
        F.least("class_id", "c").alias("a"), F.greatest("class_id", "c").alias("b")).distinct()


def estimated(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose union sketch leaves the threshold possible."""
    side = lambda name: sets.select(F.col("class_id").alias(name), F.col("sketch").alias(f"s{name}"), F.col("n").alias(f"n{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return both.filter(common >= least_shared(F.greatest("na", "nb"), percent)).select("a", "b")


def full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(class_id, sh): the full sets of the wanted classes, from a second scan of the texts, written.

    Of the rows that bear a class's id those count whose set is the class's. That is looked up in the written table:
    as a condition beside the join, Spark would build every document's set before it."""
    keys = sets.join(wanted.distinct(), "class_id", "leftsemi").select("class_id", "hi", "lo")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("class_id"), F.col(text).alias("_t")).join(keys, "class_id")
    whole = lambda s: F.struct(s.alias("sh"), F.xxhash64(s).alias("hi"), F.xxhash64(F.lit(7), s).alias("lo"))
    built = materialised(rows.select("class_id", "hi", "lo", let(F.sort_array(shingles(F.col("_t"))), whole).alias("s")), "full-sets")
    return built.filter("s.hi = hi and s.lo = lo").select("class_id", "s.sh")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int = PERCENT) -> DataFrame:
    side = lambda name: full.select(F.col("class_id").alias(name), F.col("sh").alias(f"s{name}"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(
        100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def mixed_lists(postings: DataFrame) -> DataFrame:
    """(t, most): the tokens that several components hold, with the component that has most of the list's members."""
    held = postings.groupBy("t", "comp").agg(F.count(F.lit(1)).alias("c"))
    return held.groupBy("t").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("most"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("t", "most")


def meetings(postings: DataFrame) -> DataFrame:
    """(class_id, comp, n, place of a and b): per mixed list, every member outside its largest component beside every member.

    Of two members that are not of one component at least one is outside the largest, so members of that component never
    meet each other."""
    live = postings.join(materialised(mixed_lists(postings), "mixed"), "t")
    side = lambda rows, s: rows.select("t", *[F.col(c).alias(c + s) for c in ("class_id", "comp", "n", "place")])
    return side(live.filter("comp <> most"), "a").join(side(live, "b"), "t")


def across_pairs(full: DataFrame, comps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): pairs of different components among the documents of long lists that full sets leave possible."""
    named = full.join(comps.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "class_id", F.coalesce("component", "class_id").alias("comp"), F.size("sh").alias("n"), "sh")
    rows = materialised(named, "dense")
    tokens = rows.select("class_id", F.explode("sh").alias("t"))
    df = materialised(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "dense-lists")
    held = tokens.join(df, "t").groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ts"))
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int")
    alone = F.col("n") - F.size("ts")
    placed = rows.select("class_id", "comp", "n").join(held, "class_id").filter(alone <= spare).select(
        "class_id", "comp", "n", alone.alias("alone"), F.posexplode(F.slice("ts", F.lit(1), spare - alone + 1)).alias("i", "x"))
    short = materialised(placed.select("class_id", "comp", "n", (F.col("alone") + F.col("i")).alias("place"), F.col("x.t").alias("t")), "dense-postings")
    rest = F.least(F.expr("na - placea"), F.expr("nb - placeb"))
    return meetings(short).filter("compa <> compb").filter(similar_sizes("na", "nb", percent)).filter(
        rest * (100 + percent) >= percent * F.expr("na + nb")).select(
        F.least("class_ida", "class_idb").alias("a"), F.greatest("class_ida", "class_idb").alias("b")).distinct()


def links(docs: DataFrame, sets: DataFrame, text: str = "text", short: int = SHORT, percent: int = PERCENT) -> DataFrame:
    """(a, b): confirmed links between classes, enough of them to join whatever is linked."""
    postings = rare_postings(sets, percent)
    near = materialised(estimated(short_pairs(postings, short, percent).unionByName(star_pairs(postings, short, percent)).distinct(), sets, percent), "pairs")
    dense = materialised(postings.filter(F.col("size") > short).select("class_id").distinct(), "dense-ids")
    ends = near.select(F.explode(F.array("a", "b")).alias("class_id"))
    full = full_sets(docs, sets, ends.unionByName(dense), text)
    first = materialised(confirmed(near, full, percent), "confirmed")
    if dense.isEmpty():
        return first
    comps = components(first)
    return first.unionByName(confirmed(across_pairs(full.join(dense, "class_id", "leftsemi"), comps, percent), full, percent))


def deduped(docs: DataFrame, text: str = "text", short: int = SHORT, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``. ``short`` decides how lists are compared, not what is found."""
    mark = len(scratch())
    sketches = materialised(sketched(docs, text), "sketches")
    sets = materialised(classes(sketches), "classes")
    keyed = sketches.drop("sketch").join(sets.select("hi", "lo", F.col("n").alias("n_shingles"), "class_id"), ["hi", "lo", "n_shingles"], "left")
    rows = materialised(keyed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")), "members")
    # Rows that share an id are one node: their classes are linked.
    shared = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).filter("low < high")
    same = rows.join(shared, "doc_id").select(F.col("class_id").alias("a"), F.col("low").alias("b"))
    comps = materialised(components(links(docs, sets, text, short, percent).unionByName(same)), "components")
    release_since(mark, ("members", "components"))
    found = rows.join(comps.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def kept(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group: the rows of the smallest id, and the rows without an id."""
    gone = deduped(docs, text, percent=percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "leftanti").select(*docs.columns)
