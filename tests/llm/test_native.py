"""Mixing, quality rules, chat formatting and url filters: SQL beside the queries, and the cases of the docstrings."""

import hashlib
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

from attest.llm import catalog, chat, mixing, quality, urls  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    from compare import connect
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, connection, name):
    from compare import compare
    text, ok = compare(spark, connection, name, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert ok, text


def sizes(spark, rows):
    return spark.createDataFrame(rows, "source string, size long")


def test_targets_fill_up_like_water(spark):
    # Weights 5, 2, 1: a would get 625 of 1000 but stops at 3 * 10; the rest goes 2 to 1.
    got = {r.source: r for r in mixing.source_rates(sizes(spark, [("a", 10), ("b", 490), (None, 500)])).collect()}
    assert got["a"].target == 30 and got["a"].rate == 3
    assert got["b"].target == pytest.approx(970 * 2 / 3) and got[None].target == pytest.approx(970 / 3)


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "s", 9), (1, "a b c", "s", 9), (2, None, "s", 9), (None, "x y", None, 9), (3, "", "t", 9)], "doc_id long, text string, source string, rate int")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    copies = {(r.doc_id, r.text): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    # Of 8 words source s gets 6.67 of its 6, the null source 1.33 of its 2, and t, which has none, nothing.
    assert copies[(1, "a b c")] in (2, 4) and copies.get((None, "x y"), 0) <= 1 and (3, "") not in copies
    assert mixing.mix(docs.limit(0)).collect() == []


def test_taken_words_come_near_the_target(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("w " * 7).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    rows = mixing.mix(docs).groupBy("source").count().collect()
    rates = {r.source: r.target for r in mixing.source_rates(docs.select("source", F.lit(7).cast("long").alias("size"))).collect()}
    for r in rows:
        assert r["count"] * 7 == pytest.approx(rates[r.source], rel=0.03)


def brute_repeat_words(text):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    return len({p for places in seen.values() if len(places) > 1 for i in places for p in (i, i + 1, i + 2)})


def test_quality_counts(spark):
    texts = ["", None, "a b", "a b c", "a b c a b c", "x x x x", "one\ntwo\none\n\n \n one", "# $% <|> 100%", "日本 語 日本 語 日本 語", "a b c d " * 500]
    docs = spark.createDataFrame([(i, t, "h", True) for i, t in enumerate(texts)], "doc_id long, text string, source string, kept boolean")
    got = {r.doc_id: r for r in quality.measured(docs).collect()}
    assert [got[i].n_repeat_words for i in range(len(texts))] == [brute_repeat_words(t or "") for t in texts]
    assert got[6].n_dup_lines == 1 and got[7].n_symbols == 7 and got[8].word_chars == 9 and got[1].base_failed
    assert quality.kept(docs).columns == docs.columns
    assert quality.rules(docs.limit(0)).collect() == []


def test_hosts(spark):
    good, junk = " ".join(f"word{i}" for i in range(60)), "# " * 60
    rows = [(i, good, "fine") for i in range(30)] + [(100, junk + good, "fine")] + [(200 + i, junk + good, None) for i in range(30)] + [(300, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.kept(docs).collect()}
    # The junk of a good host stays, that of a failing host goes, and a clean document stays anywhere.
    assert kept == {*range(30), 100, 300}


def test_templates_are_read_back(spark):
    texts = ["plain", "", None, "</s>[INST] ok [/INST]", "<|end|><|role|>user<|text|>", "\\<\\\\[\\", "a\nb", "🙂<|é"]
    rows = [(1, i, ("user", "assistant", None, "odd<|text|>role")[i % 4], t) for i, t in enumerate(texts)]
    rows += [(None, 0, "assistant", "no id"), (2, None, "user", "x"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = {r.tree_id: r for r in chat.read_back(chat.formatted(chat.reply_rows(talk))).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [(r[2] or "", r[3] or "") for r in rows[:8]]
    assert read[1].learnt == [r[3] or "" for r in rows[:8] if r[2] == "assistant"]
    assert [t.text for t in read[2].turns] == ["x", "a", "a", "b"] and read[None].learnt == ["no id"]
    body = "".join(p.split("<|text|>")[1] for p in read[1].formatted.split("<|end|>")[:-1])
    assert not any(mark in body for mark in ("<|", "</s>", "[INST]", "[/INST]"))
    assert chat.formatted(chat.reply_rows(talk.limit(0))).collect() == []


def test_branches_of_a_tree(spark):
    #      1 - 2 - 3        scores: the branch through 4 is the better one
    #        \ 4 - 5 - 6
    rows = [(0, 1, None, 0.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 1, 2.0), (0, 5, 4, 2.0), (0, 6, 5, 2.0), (0, 8, 9, 1.0), (0, 9, 8, 1.0)]
    tree = spark.createDataFrame([(t, n, p, "user", f"m{n}", s) for t, n, p, s in rows], "tree_id long, node_id long, parent_id long, role string, text string, score double")
    def paths(k):
        found = {}
        for r in chat.chosen_paths(tree, k).orderBy("place").collect():
            found.setdefault(r.leaf_id, []).append(r.node_id)
        return found
    assert paths(1) == {6: [1, 4, 5, 6]}
    assert paths(2) == {6: [1, 4, 5, 6], 3: [1, 2, 3]}


def test_long_chains(spark):
    n = 700
    talk = spark.range(n).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat.read_back(chat.formatted(chat.reply_rows(talk))).first()
    assert hashlib.sha256("".join(row.learnt).encode()).hexdigest() == hashlib.sha256("".join(map(str, range(n))).encode()).hexdigest()


def test_rules_of_urls(spark):
    table = ["http://x.example.net/en/1", "http://example.net/en", "https://NET/", "http://net", "http://a.ORG/fr/x?y#z", "ftp://example.com/de/", "x://notnet/", None, "no scheme", "http://b.com/p?a=1&b=2", "http://c.net:80/q", "a://b://net/", "http://x.net/\n?q"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(table)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urls.judged(pages).collect()}
    assert [got[i].rule for i in range(len(table))] == ["example.net/en/", "net/", "net/", None, "org/fr/", "example.com/de/", None, None, None, None, None, None, "net/"]
    assert (got[4].host, got[4].path, got[7].host, got[8].path, got[12].path) == ("a.org", "/fr/x", "", "", "/\n")
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and got[2].verdict == "block" and got[4].verdict == "allow"
    assert urls.judged(pages.limit(0)).collect() == []
    assert urls.judged(pages.filter("page_id in (2, 9)")).filter("page_id = 9").first().verdict == "block"


def test_trees_learn_what_rules_say(spark):
    """Held out: hosts of a suffix that is mostly blocked, beside hosts of one that is mostly allowed."""
    rows = [(i, f"http://h{i % 40}.{'net' if i % 2 else 'org'}/{'fr' if i % 2 == 0 else 'x'}/{i}") for i in range(400)] + [(1000, "http://new.org/de/1")]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string"))
    assert got.filter("page_id = 1000").first().verdict == "allow"
