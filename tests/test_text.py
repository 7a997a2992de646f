"""Text rules and output parsing on small frames."""

import pytest
from pyspark.sql import functions as F

from attest.functions import repair as rp, text as tx
from attest.operators import extraction as ex, texts as ot


def value(spark, column_of, text):
    return spark.createDataFrame([(text,)], "t string").select(column_of(F.col("t")).alias("v")).first().v


def test_tokens_are_unicode(spark):
    assert value(spark, tx.tokens, "Éaile über x_1, Ça!") == ["éaile", "über", "x_1", "ça"]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 9, 17])
@pytest.mark.parametrize("size,overlap", [(5, 0), (5, 2), (5, 4)])
def test_chunks_equal_the_sliding_window(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    expected, start = [], 0
    while start < n:
        expected.append(" ".join(words[start:start + size]))
        if start + size >= n:
            break
        start += size - overlap
    assert value(spark, lambda c: tx.chunks(c, size, overlap), " ".join(words)) == expected


def test_overlap_must_be_smaller_than_size():
    with pytest.raises(ValueError):
        tx.chunks(F.lit("a") if False else None, 5, 5)


def test_empty_text_keeps_one_chunk_row(spark):
    docs = spark.createDataFrame([("d", ""), ("e", "a b c")], "doc_id string, text string")
    got = sorted((r.chunk_id, r.text) for r in ot.chunk_table(docs, 2, 0).collect())
    assert got == [("d", ""), ("e::chunk-0", "a b"), ("e::chunk-1", "c")]


@pytest.mark.parametrize("text,expected", [
    ("1 A\n2 B\nx", [("preamble", "preamble\n1 A"), ("2 B", "B\nx")]),
    ("x\n1 A\ny\n2.1 B", [("preamble", "preamble\nx"), ("1 A", "A\ny")]),
    ("INTRO\nTEXT HERE\nbody", [("preamble", "preamble\nINTRO"), ("TEXT HERE", "TEXT HERE\nbody")]),
    ("body\n1 A\n2 B\n3 C\nend", [("preamble", "preamble\nbody"), ("1 A", "A\n2 B"), ("3 C", "C\nend")]),
    ("", []),
])
def test_sections(spark, text, expected):
    assert [tuple(s) for s in value(spark, tx.sections, text)] == expected


def test_labelled_sections(spark):
    text = "before\nECG: one\n two \nCT:\nMRI: m\necg: later\nECG machine report: a; b"
    got = [tuple(s) for s in value(spark, tx.labelled_sections, text)]
    assert got == [("ECG", "later"), ("MRI", "m"), ("ECG machine report", "a; b")]
    assert value(spark, tx.labelled_sections, "nothing here") == []


def test_clean_note(spark):
    raw = ("note_id: 7; subject_id: 8\\nChief complaint: pain ___ left  side   \r\nX-ray: ['clear']\n\n\n\nIMPRESSION: bad\n more\n\n"
           "ECG machine report: AF; AF ; ; flutter; AF")
    assert value(spark, tx.clean_note, raw) == "Chief complaint: pain left side\nX-ray: clear\n\nECG machine report: AF; flutter."


def test_clean_evidence(spark):
    assert value(spark, tx.clean_evidence, "<p>a&#xb7;b &lt;c&gt;</p>\n d&amp;e") == "a·b <c> d&e"


def test_references_without_semicolon(spark):
    cut = "<h1>ver&amp</h1> &copy; x&amp;y &#39 &ampz; &middot;"
    assert value(spark, tx.clean_evidence, cut) == "ver& © x&y ' &z; ·"
    assert value(spark, lambda c: tx.clean_evidence(c, bare=False), cut) == "ver&amp © x&y &#39 &ampz; ·"


def test_txt_09_keeps_cut_references(spark, tmp_path):
    from attest.catalog import queries
    pages = [(1, "u", "<h1>ver&amp</h1>&copy; a&amp;b &middot;")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries()["txt_09"](spark, str(tmp_path)).collect() == [(1, "ver&amp © a&b ·")]


def test_sentence_rules(spark):
    t = "One two. three. Four? Five"
    assert value(spark, tx.sentences, t) == ["One two. three.", "Four?", "Five"]
    assert value(spark, tx.sentences_any, t) == ["One two.", "three.", "Four?", "Five"]
    assert value(spark, tx.sentences, "  ") == []
    long = "The man had chest pain, and he also had fever; ok furthermore he was cold today."
    assert value(spark, tx.atomic_facts, long) == ["The man had chest pain", "he also had fever", "he was cold today."]


@pytest.mark.parametrize("text", ["", " ", "\n", " \n \n", "\t"])
def test_blank_texts_hold_no_facts(spark, text):
    assert value(spark, tx.atomic_facts, text) == []


def test_conjunctions_in_any_letter_case(spark):
    start = "He was seen today in the ward at noon"
    for conjunction in (", AND", "ALONGSIDE", "along\u017fide", "Compounded By"):
        assert value(spark, tx.atomic_facts, f"{start} {conjunction} his wife") == [start, "his wife"]


def test_txt_12_equals_its_sql_on_blank_texts(spark, tmp_path):
    import duckdb
    from attest.catalog import oracles, queries
    docs = [(0, ""), (1, " \n"), (2, None), (3, "A. B! Ok. Ok."), (4, "The man had chest pain, and he also had fever; ok. \n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries()["txt_12"](spark, str(tmp_path)).select("doc_id", "fact", "n").collect())
    assert got == sorted(connection.execute(f"SELECT doc_id, fact, n FROM ({oracles()['txt_12']})").fetchall())
    assert {r[0] for r in got} == {3, 4}


def test_thinking_channels(spark):
    assert value(spark, tx.strip_thinking, "x<|channel|>final {1}<|end|> y") == "{1}"
    assert value(spark, tx.strip_thinking, "analysis hm assistantfinal {2}") == "{2}"
    assert value(spark, tx.strip_thinking, "plain") == "plain"


def test_verdict_with_confidence(spark):
    rows = ["Verdict: TRUE\nConfidence: 0.8", "Verdict: false. Confidence: HIGH", "true", "Verdict: TRUE\nconfidence: 0.8.", "no idea"]
    got = [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "t string").select(*tx.verdict_with_confidence(F.col("t"))).collect()]
    assert got == [(True, 0.8), (False, 0.9), (True, 0.5), (True, 0.5), (False, 0.5)]


def test_ranked_items(spark):
    t = "Intro\nDiagnoses:\n1. AF\n2) HF\n- flu\n\nProcedures:\n1. x"
    assert value(spark, lambda c: tx.ranked_items(c, "Diagnoses"), t) == ["AF", "HF", "flu"]
    assert value(spark, lambda c: tx.ranked_items(c, "Procedures"), t) == ["x"]
    assert value(spark, lambda c: tx.ranked_items(c, "Other"), t) == []


def test_json_must_be_one_value(spark):
    rows = ['{"a": 1}', '{"a": 1}]', '{"a": 1}}', '{"a": 1} x', '{"a": 1}, "b": 2', "", "{'a': 1}", "[1]"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(rp.is_json(F.col("t"))).collect()]
    assert got == [True, False, False, False, False, False, False, True]


def test_json_beside_the_mark_that_follows_it(spark):
    rows = ['1,"endofthetriedtext"] x', '1,"\\u0065ndofthetriedtext"] x', '["endofthetriedtext"]', '"\\u0065"', "1] x", '1, "a', "1,", "1 2", " \n1 ", "\xa0", '{"a": 1, "a": 2}', None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(rp.is_json(F.col("t"))).collect()]
    assert got == [False, False, True, True, False, False, False, False, True, False, False, False]


def test_stored_outputs_are_cut_by_rows(spark, monkeypatch):
    """Few bytes of outputs take long to parse, so more than one task must be able to read them."""
    from attest.catalog import extraction
    monkeypatch.setattr(extraction, "FILE_ROWS", 100)
    for stored in (extraction.critique_outputs, extraction.outputs):
        sizes = [r["count"] for r in stored(spark, "/root/testdata/sf0.001").groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) > 8 and max(sizes) <= 100


def test_critiques_are_parsed_once(spark):
    """Both readers take the critiques twice; they are computed once."""
    from attest.operators import pairs, routing
    seen = spark.sparkContext.accumulator(0)

    def parsed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    predictions = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "C")], "case_id long, rnk int, label string")
    rows = spark.createDataFrame([(1, 0, "A", "HIGH", False), (1, 5, "b", "LOW", True)],
                                 "case_id long, critique_idx int, label string, confidence string, needs_evidence boolean")
    critiques = rows.mapInArrow(parsed, rows.schema)
    matched = {(r.case_id, r.rnk): r.needs_evidence for r in pairs.match_critiques(predictions, critiques).collect()}
    assert matched == {(1, 1): False, (1, 2): True, (2, 1): None} and seen.value == 2
    assert routing.with_fallback(predictions, critiques).count() == 3 and seen.value == 4


def items(*names, reason="r"):
    return ", ".join('{"name": "%s", "reasoning": "%s"}' % (n, reason) for n in names)


@pytest.mark.parametrize("raw,stage,labels,ok", [
    ('{"diagnoses": [%s]}' % items("a", "b", "c"), "clean", ["a", "b", "c"], True),
    ('{"diagnoses": [%s]}' % items("a", "b"), "clean", ["a", "b"], False),
    ('```json\n{"diagnoses": [%s]}\n```' % items("a", "b", "c"), "clean", ["a", "b", "c"], True),
    ('{"Diagnosis_list": [%s,]}' % items("a", "b", "c").replace('"name"', '"Title"'), "repaired", ["a", "b", "c"], True),
    ('{"diagnoses": [%s]}' % items("a", "b", "c", reason='the "usual" kind'), "repaired", ["a", "b", "c"], True),
    ("1. AF\nfast\n2. HF\nweak\n3. MI\npain", "pattern", ["AF", "HF", "MI"], True),
    ('[%s]' % items("a", "b", "c"), "pattern", ["a", "b", "c"], True),
    ("", "failed", [], False),
])
def test_attempt_parsing(spark, raw, stage, labels, ok):
    row = ex.parse_attempts(spark.createDataFrame([(1, raw)], "case_id int, raw_output string")).first()
    assert row.stage == stage and row.parse_success == ok
    assert [i.label for i in row["items"] if i.label] == labels and len(row["items"]) == 5


def test_critiques(spark):
    raw = 'ok {"critiques": [{"diagnosis": "a", "confidence": "high", "needs_evidence": false}, {"name": "b", "confidence": "sure", "needs_evidence": "no"}, {"name": "c"}]} bye'
    rows = spark.createDataFrame([(1, raw), (2, "none"), (3, "")], "case_id int, raw_output string")
    got = {r.case_id: r.critiques and [(c.label, c.confidence, c.needs_evidence) for c in r.critiques] for r in ex.parse_critiques(rows).collect()}
    assert got == {1: [("a", "HIGH", False), ("b", "LOW", False), ("c", "LOW", True)], 2: None, 3: None}


def test_error_classes(spark):
    rows = [('{"a": 1', "incomplete_json"), ("Sure: {\"a\": 1}", "extra_text"), ("", "empty_output"), ('{"a": [1}]}', "incomplete_json"), ('{"a": \x01 1}', "encoding")]
    got = [r[0] for r in spark.createDataFrame([(r[0],) for r in rows], "t string").select(rp.error_class(F.col("t"), F.lit(None).cast("string"))).collect()]
    assert got == [r[1] for r in rows]


def test_mcq_answers(spark):
    rows = ['{"answer": "b", "reasoning": "x"}', "```json\n{\"answer\": \"C\"}\n```", "The correct is (d)", "A, because", "Because", '{"answer": "E"}', ""]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(rp.mcq_answer(F.col("t"))["answer"]).collect()]
    assert got == ["B", "C", "D", "A", None, None, None]


def test_vocabulary_paths_agree(spark):
    texts = spark.createDataFrame([(1, "Atrial flutter and en"), (2, "none"), (3, "xen")], "doc_id int, text string")
    words = spark.createDataFrame([("flutter",), ("en",), ("atrial fl",), ("zz",)], "concept string")
    small = {tuple(r) for r in ot.mentions(texts, words, "doc_id").collect()}
    large = {tuple(r) for r in ot.mentions(texts, words, "doc_id", max_array=1).collect()}
    assert small == large == {(1, "flutter"), (1, "en"), (1, "atrial fl"), (3, "en")}


def test_modules_import_without_a_session():
    import subprocess
    import sys
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 190 and e.oracle_sql()"], check=True,
                   cwd=__file__.rsplit("/tests/", 1)[0])


def test_error_patterns_end_with_the_deciding_mark(spark):
    rows = [("", None, []), ("{", "key", ["appears_truncated", "unmatched_braces"]), ("{[}", "key", ["appears_truncated", "unmatched_brackets"]),
            ("so: {} \\u00e9", "key", ["appears_truncated", "extra_text_before"]), ("{} \\u00e9", "JSON decode: Expecting x", ["appears_truncated", "escape_sequences", "json_syntax_expecting"]),
            ("{}\x01", "type", ["appears_truncated", "control_characters"]), ("{}", "json decode extra data", ["appears_truncated", "json_extra_data"]),
            ("{}", "no such field", ["appears_truncated", "missing_field"]), ("{}", "bad type", ["appears_truncated", "type_error"]), ("text", "bad type", ["appears_truncated", "extra_text_before", "type_error"])]
    got = spark.createDataFrame([r[:2] for r in rows], "t string, m string").select(rp.error_patterns(F.col("t"), F.col("m"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]


def test_report_lines_are_cleaned_one_by_one(spark):
    note = "x\nECG machine report: a; a; b\ny ECG machine report: b; b\nECG machine report: "
    assert spark.range(1).select(tx.dedupe_report(F.lit(note))).first()[0] == "x\nECG machine report: a; b.\ny ECG machine report: b.\nECG machine report: ."


def _escaped(text):
    """The state machine, mark by mark."""
    out, inside, i = [], False, 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            out.append(text[i:i + 2])
            i += 2
            continue
        if text[i] == '"':
            ahead = text[i + 1:i + 20].lstrip()
            key = len(ahead) > 1 and ahead[0] == '"' and (ahead[1:].lstrip() or ":")[0] == ":"
            if not inside:
                inside = True
            elif key or ahead[:1] in (":", ",", "}", "]"):
                inside = False
            else:
                out.append("\\")
        out.append(text[i])
        i += 1
    return "".join(out)


def test_inner_quotes_as_the_state_machine(spark):
    import random
    draw = random.Random(8)
    texts = ["", '"', '\\', '"a"', '{"a": "b "c" d", "e": "f"}', 'x \\" "y\\\\" z', '"' + " " * 17 + ",", '"' + " " * 18 + ",", '"' + " " * 19 + ","]
    texts += ["".join(draw.choice('"""\\:,}] a\n\xa0') for _ in range(draw.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(draw.choice(['"', " ", " ", " ", " ", " ", ":"]) for _ in range(60)) for _ in range(1000)]
    texts += ['{"k": "v ' + 'say "hi" ' * 20_000 + '"}', '"a", ' * 50_000, "\\\\" * 50_000 + '"' * 1000]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").select("i", rp.escape_inner_quotes(F.col("t")).alias("e")).collect()
    assert {r.i: r.e for r in found} == {-1: None, **{i: _escaped(t) for i, t in enumerate(texts)}}


def test_entities_as_the_standard_library(spark):
    import html
    import random
    from html.entities import html5

    from attest.functions.entities import decode_entities
    draw = random.Random(5)
    texts = ["", "no reference", "&", "&&amp;&", "&amp", "&ampx", "&notit;", "&notin;", "&#65;", "&#65", "&#x41;B", "&#X41", "&#0;&#13;&#128;&#x81;&#159;", "&#xD800;&#x110000;&#99999999999999;",
             "&#1;&#11;&#127;&#xFDD0;&#xFFFE;&#x1FFFF;", "&#x1F600;&#128512", "&#0000000000065;", "&nosuchthing;", "&lt;b&gt;", "&quot", "&a b&;", "&\n&#;", "&#x;", "&NotEqualTilde;", "&" + "x" * 40, "&é;"]
    texts += [f"&{name}" for name in draw.sample(sorted(html5), 400)] + [f"a&{name.rstrip(';')}z;b" for name in draw.sample(sorted(html5), 200)]
    texts += ["".join(draw.choice(["&", "#", "x", "1", "a", "amp", "lt", ";", " ", "not", "in", "F6"]) for _ in range(draw.randint(1, 12))) for _ in range(500)]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").select("i", decode_entities(F.col("t")).alias("d")).collect()
    got = {r.i: r.d for r in found}
    assert got.pop(-1) is None
    assert {t: got[i] for i, t in enumerate(texts)} == {t: html.unescape(t) for t in texts}
