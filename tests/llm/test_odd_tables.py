"""Every operator over tables whose other columns bear the names it uses inside, and over very long texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attest.llm import alignment, bpe, chat, classifier, codes, mixing, neardup, neighbours, quality, suffixes, tokens, urls, warc
from attest.llm.common import MOST_TASKS, dealt, fresh

# Names of columns that operators make on their way.
INSIDE = """_host of_host counts _counts own_rate own_copies rate_source _rate_source copy _copy rate copies target source_size size digest _features url_features blocked _blocked _weight _h label
    copies suffix domain f_suffix n rank row pairs links pair best more_best place weight of_id text_of spread of_spread of_label comp compa token hash sk x y z a b first last next at file
    start ordinal vector ids labels numbers orders code error payload n_words host kept""".split()


def clashing(df, *own):
    return df.select("*", *[F.lit("clash").alias(c) for c in dict.fromkeys(INSIDE) if c.lower() not in {o.lower() for o in (*df.columns, *own)}])


LINE = " ".join(f"word{i}" for i in range(70))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LINE, "en", "s"), (2, LINE + " more", "en", "s"), (3, "short", "de", "t"), (None, None, None, None), (4, LINE[::-1], "en", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


OPERATORS = {
    "op1": lambda d: mixing.mix(d), "op4": lambda d: neardup.deduped(d), "op4 kept": lambda d: neardup.kept(d, percent=80), "op6": lambda d: quality.kept(d), "op6 rules": lambda d: quality.rules(d),
    "op7": lambda d: suffixes.removed(d), "op7 cleaned": lambda d: suffixes.cleaned(d), "op8": lambda d: tokens.token_counts(d), "op10": lambda d: bpe.digests(d), "op11": lambda d: alignment.summaries(d),
    "op11 aligned": lambda d: alignment.aligned(d)}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents_with_clashing_columns(docs, name):
    plain, odd = OPERATORS[name](docs), OPERATORS[name](clashing(docs))
    names = [c for c in plain.columns if c in odd.columns]
    assert set(plain.columns) <= set(odd.columns)
    rows = lambda df: sorted(map(str, df.select(*names).collect()))
    assert rows(plain) == rows(odd)


def test_other_tables_with_clashing_columns(spark, docs):
    pages = spark.createDataFrame([(1, "http://a.net/x/1", "<p>" * 50), (2, "http://b.example.org/fr/2", "<p>" * 50), (3, None, None)], "page_id long, url string, html string")
    assert sorted(map(str, urls.judged(clashing(pages)).select("page_id", "rule", "verdict").collect())) == sorted(map(str, urls.judged(pages).select("page_id", "rule", "verdict").collect()))
    assert sorted(map(str, warc.round_trip(clashing(pages)).collect())) == sorted(map(str, warc.round_trip(pages).collect()))
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3), 2.0] * 4, i % 2) for i in range(90)], "vec_id long, embedding array<float>, label int")
    assert codes.with_label_errors(codes.compressed(clashing(vectors))[0]).count() == 90
    indexed = neighbours.index(clashing(vectors))
    assert neighbours.search(indexed, indexed.filter("vec_id = 0"), 5).count() == 5
    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(chat.reply_rows(clashing(talk)))).count() == 1
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert classifier.judged(clashing(docs, "quality"), clashing(labels)).count() == docs.count()


def test_names_and_tasks(spark):
    assert fresh("a", "A", "_a") == "__a" and fresh("a") == "a"
    assert dealt(spark.range(10_000)).rdd.getNumPartitions() == MOST_TASKS
    assert dealt(spark.range(10_000), 50).rdd.getNumPartitions() == 50 and dealt(spark.range(3)).rdd.getNumPartitions() == 3


def test_draws_of_rows_without_an_id_differ(spark):
    rows = [(None, f"text number {i} of many", "abc"[i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goal = {r.source: r.target for r in mixing.source_rates(docs.select("source", mixing.n_words(F.col("text")).alias("size"))).collect()}
    for r in mixing.mix(docs).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("taken")).collect():
        assert r.taken == pytest.approx(goal[r.source], rel=0.1)


@pytest.fixture(scope="module")
def long_docs(spark):
    """Five megabytes of words, a megabyte without a break, and the first again with a word less."""
    words = " ".join(f"w{i * 7919 % 100_003}" for i in range(760_000))
    return spark.createDataFrame([(1, words, "en", "s"), (2, "x7" * 500_000, "en", "s"), (3, words[: words.rindex(" ")], "en", "t")], "doc_id long, text string, lang string, source string"), words


def test_very_long_texts(spark, long_docs):
    docs, words = long_docs
    assert len(words) > 5_000_000
    n = len(words.split())
    measured = {r.doc_id: r for r in quality.measured(docs).select("doc_id", "n_words", "n_repeat_words").collect()}
    assert [measured[i].n_words for i in (1, 2, 3)] == [n, 1, n - 1]
    assert {r.doc_id: r.size for r in docs.select("doc_id", mixing.n_words(F.col("text")).alias("size")).collect()} == {1: n, 2: 1, 3: n - 1}
    assert {r.doc_id: r.component_id for r in neardup.deduped(docs).collect()} == {1: 1, 2: 2, 3: 1}
    digests = {r.doc_id: r.decoded_sha256 for r in bpe.digests(docs).collect()}
    assert digests[1] == hashlib.sha256(words.encode()).hexdigest() and digests[2] == hashlib.sha256(b"x7" * 500_000).hexdigest()
    cut = {r.doc_id: r for r in suffixes.removed(docs.select("doc_id", "text")).collect()}
    assert (cut[1].n_removed, cut[2].n_removed, cut[3].n_removed) == (0, 0, len(words[: words.rindex(" ")]))


def test_very_long_messages(spark, long_docs):
    _, words = long_docs
    talk = spark.createDataFrame([(1, 0, "user", words), (1, 1, "assistant", "</s>" * 250_000)], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.formatted(chat.reply_rows(talk))).first()
    assert [t["text"] for t in row.turns] == [words, "</s>" * 250_000] and list(row.learnt) == ["</s>" * 250_000]
