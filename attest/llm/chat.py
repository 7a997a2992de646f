"""Reply trees as conversations in a chat template.

Messages point at the message they answer. Root-to-leaf paths are found by self-joins that double the
reach of every message's pointer, so a tree of depth d takes log2(d) joins and each holds one row per
message, never a list of ancestors. Branches are ranked by score, and each chosen path becomes one
conversation: a string, its turns and the loss mask over the assistant texts.

The template writes ``<|role|>ROLE<|text|>TEXT<|end|>`` per turn. Inside ROLE and TEXT a backslash is doubled
and ``<`` and ``[`` are followed by one, so neither the template's marks nor those of other templates occur
in them, and the way back is exact.

Defined results: null roles and texts are empty; rows of one conversation are ordered by turn, null first,
then by role and text, so ties and repeated rows all keep their place; a null conversation id is a
conversation of its own; an empty table gives an empty result; other columns are ignored. A message
whose parent is null or missing is a root; messages on a cycle have no root and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import let, materialised

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    filled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(filled, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescaped(text: Column) -> Column:
    bare = F.replace(F.replace(text, F.lit("<\\"), F.lit("<")), F.lit("[\\"), F.lit("["))
    return F.replace(bare, F.lit("\\\\"), F.lit("\\"))


def reply_rows(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations: each answers the one before it, and all scores are equal."""
    order = W.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    place = F.row_number().over(order).cast("bigint")
    return conversations.select(
        F.col("conv_id").alias("tree_id"), place.alias("node_id"), "role", "text", F.lit(0.0).alias("score")
    ).withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1))


def paths(messages: DataFrame) -> DataFrame:
    """(tree_id, node_id, root_id, depth, path_score, leaf): for every message its root, the messages on
    the way to it, the sum of their scores, and whether no message answers it."""
    keyed = messages.select("tree_id", "node_id", "parent_id", "score")
    known = keyed.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"))
    parents = keyed.filter("parent_id is not null").select(F.col("tree_id").alias("_t"), F.col("parent_id").alias("_n")).distinct()
    at = lambda left: F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col(left) == F.col("_n"))
    start = (
        keyed.join(known, at("parent_id"), "left")
        .withColumn("up", F.col("_n")).drop("_t", "_n")
        .join(parents, at("node_id"), "left")
        .select("tree_id", "node_id", "up", F.col("_n").isNull().alias("leaf"),
                F.when(F.col("up").isNull(), F.col("node_id")).alias("root_id"),
                F.lit(1).cast("bigint").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("path_score")))
    reach = materialised(start, "paths")
    waiting, done = reach.filter("up is not null"), reach.filter("up is null")
    n, before = waiting.count(), None
    # Every round doubles the distance that ``up`` spans, and only messages that have not come to a root are joined;
    # on a cycle nothing comes to one any more.
    while n and n != before:
        further = done.unionByName(waiting).select(
            F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("up").alias("_up"),
            F.col("root_id").alias("_root"), F.col("depth").alias("_depth"), F.col("path_score").alias("_score"))
        reach = materialised(
            waiting.join(further, at("up"), "left").select(
                "tree_id", "node_id", F.col("_up").alias("up"), "leaf", F.coalesce("root_id", "_root").alias("root_id"),
                (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
                (F.col("path_score") + F.coalesce("_score", F.lit(0.0))).alias("path_score")), "paths")
        done, waiting = done.unionByName(reach.filter("up is null")), reach.filter("up is not null")
        before, n = n, waiting.count()
    return done.filter("root_id is not null").drop("up")


def chosen_paths(messages: DataFrame, per_root: int = 1) -> DataFrame:
    """(tree_id, leaf_id, node_id, place): the messages of the best ``per_root`` paths of every root, ranked by
    mean score, then by length, then by leaf. A message appears once for each chosen path it lies on."""
    found = materialised(paths(messages), "trees")
    best = W.partitionBy("tree_id", "root_id").orderBy((F.col("path_score") / F.col("depth")).desc(), F.col("depth").desc(), "node_id")
    leaves = found.filter("leaf").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_root)
    # Going down from the root: a message lies on the path to a leaf if it is the leaf or the parent of one that does.
    # Pointers are doubled again, now with the set of marked messages growing at each step.
    links = messages.filter("parent_id is not null").select("tree_id", "node_id", "parent_id")
    marked = materialised(leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id"), "marked")
    jump = materialised(links.join(found.select("tree_id", "node_id"), ["tree_id", "node_id"], "leftsemi")
                        .unionByName(links.filter("tree_id is null")).dropDuplicates(["tree_id", "node_id"]), "jump")
    count = marked.count()
    while True:
        j = jump.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("parent_id").alias("_p"))
        on = F.col("tree_id").eqNullSafe(F.col("_t"))
        above = marked.join(j, on & (F.col("node_id") == F.col("_n"))).select("tree_id", "leaf_id", F.col("_p").alias("node_id"))
        marked = materialised(marked.unionByName(above).distinct(), "marked")
        now = marked.count()
        if now == count:
            break
        count = now
        jump = materialised(jump.join(j, on & (F.col("parent_id") == F.col("_n"))).select("tree_id", "node_id", F.col("_p").alias("parent_id")), "jump")
    place = found.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("depth").alias("place"))
    return marked.join(place, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("node_id") == F.col("_n"))).drop("_t", "_n")


def formatted(messages: DataFrame, per_root: int = 1, learnt: str = LEARNT) -> DataFrame:
    """(tree_id, leaf_id, formatted, mask): one row per chosen path. ``mask`` holds (turn, start, length): the
    stretches of code points, counted from the start of their turn, over which a loss is taken."""
    text = messages.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = chosen_paths(messages, per_root).join(text, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("node_id") == F.col("_n")))
    head = F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(TEXT))
    body = escaped(F.col("text"))
    turn = rows.select(
        "tree_id", "leaf_id", "place", F.concat(head, body, F.lit(END)).alias("turn"),
        F.when(F.col("role") == learnt, F.struct(F.length(head).alias("start"), F.length(body).alias("length"))).alias("span"))
    gathered = turn.groupBy("tree_id", "leaf_id").agg(F.sort_array(F.collect_list(F.struct("place", "turn", "span"))).alias("turns"))
    mask = F.filter(
        F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["span"]["start"].alias("start"), t["span"]["length"].alias("length"))),
        lambda s: s["start"].isNotNull())
    return gathered.select("tree_id", "leaf_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), mask.alias("mask"))


def read_back(texts: DataFrame) -> DataFrame:
    """``texts`` with ``turns`` (role, text) and ``learnt`` (the unescaped texts under the mask), from the strings alone."""
    pieces = F.split("formatted", r"<\|end\|>")
    cut = lambda p: F.split(F.substring(p, F.lit(len(ROLE) + 1), F.length(p)), r"<\|text\|>")
    both = let(pieces, lambda ps: F.struct(
        F.transform(F.slice(ps, F.lit(1), F.size(ps) - 1), lambda p: let(cut(p), lambda c: F.struct(
            unescaped(c[0]).alias("role"), unescaped(c[1]).alias("text")))).alias("turns"),
        F.transform("mask", lambda s: unescaped(F.substring(F.get(ps, s["turn"]), s["start"] + 1, s["length"]))).alias("learnt")))
    return texts.withColumn("_read", both).select("*", F.col("_read")["turns"].alias("turns"), F.col("_read")["learnt"].alias("learnt")).drop("_read")
