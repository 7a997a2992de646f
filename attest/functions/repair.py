"""Reading JSON that a model wrote: validity, repair, and the fallbacks, as Columns."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame, functions as F

from .text import let, strip, strip_thinking

# Key names and their canonical form.
LIST_KEYS = ("diagnoses", "diagnosis", "estimates", "diseases", "conditions", "findings")
LIST_ALIASES = ("estimates", "diseases", "conditions", "findings", "results", "predictions", "assessments", "conclusions")
NAME_KEYS = ("name", "title", "diagnosis")
REASONING_KEYS = ("reasoning", "reason", "rationale", "explanation", "description")
REASONING_ALIASES = ("description", "explanation", "rationale", "justification")
CRITIQUE_KEYS = ("critiques", "critique", "evaluations", "assessments", "results")
LIST_OBJECT = r"""(?is)\{[^{}]*["'](?:diagnos\w*|diagnosis|estimates|diseases|conditions|findings|results)["'][^{}]*\[.*?\]\s*\}"""
OBJECT_PAIR = r"""(?is)\{[^}]*["']?(?:name|Name)["']?\s*:\s*["']([^"']+)["'][^}]*["']?(?:reasoning|Reasoning|reason)["']?\s*:\s*["']([^"']+)["']"""
KEY_VALUE = r"""(?is)["']?(?:name|Name)["']?\s*:\s*["']([^"']+)["'][^{}\n]*["']?(?:reasoning|Reasoning|reason)["']?\s*:\s*["']([^"']+)["']"""
NUMBERED = r"(?smd)(?:^|\n)\s*(\d+)[.):\s]+([^\n]+?)(?:\n|$)(.*?)(?=(?:\n\s*\d+[.):\s])|$)"

ITEM = "struct<label:string,reasoning:string>"
STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
LENGTH = 5


# Follows the text to be tried in a list. A text that could bring it along, spelt out or in escapes, is parsed twice.
AFTER = "endofthetriedtext"


def is_json(c: Column) -> Column:
    """True for a text that is one JSON value and nothing more. The parser ignores what follows a
    value, so the text is tried inside a list, before a mark that is its second item only if the text is one value. A text
    that could hold the mark is tried inside a list and inside an object, which cannot both absorb what follows."""
    marked = F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{AFTER}"]')))
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    twice = F.contains(c, F.lit(AFTER)) | F.contains(c, F.lit("\\u"))
    return F.when(twice, listed.isNotNull() & named.isNotNull()).otherwise(
        F.coalesce(F.try_variant_get(marked, "$[1]", "string") == AFTER, F.lit(False)))


def without_fence(c: Column) -> Column:
    """The text inside a code fence, if there is one."""
    def inside(text, opener):
        body = F.regexp_extract(text, r"(?s)" + opener + r"\s*(.*?)\s*```", 1)
        return F.when(text.rlike(r"(?s)" + opener + r"\s*(.*?)\s*```"), body).otherwise(text)
    return let(strip(c), lambda t: F.when(F.contains(t, F.lit("```json")), inside(t, "```json"))
               .when(F.contains(t, F.lit("```")), inside(t, "```")).otherwise(t))


def list_object(c: Column) -> Column:
    """The object that holds a diagnosis-like list, else the text as it is."""
    return let(without_fence(c), lambda t: let(
        F.regexp_extract(t, LIST_OBJECT, 0), lambda o: F.when(o != "", o).otherwise(t)))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _canonical_key(key: Column) -> Column:
    def mapped(k):
        return (F.when(F.contains(k, F.lit("diag")), "diagnoses")
                .when(k.isin(*LIST_ALIASES), "diagnoses").when(F.contains(k, F.lit("differential")), "diagnoses")
                .when(F.contains(k, F.lit("reason")), "reasoning")
                .when(F.contains(k, F.lit("nam")) | (k == "title"), "name")
                .when(k.isin(*REASONING_ALIASES), "reasoning").otherwise(k))
    plain = F.when(is_ascii(key), key).otherwise(F.regexp_replace(key, "[^\\x00-\\x7F]", ""))
    return let(F.lower(plain), mapped)


def canonical_keys(c: Column) -> Column:
    """Rename every key to its canonical form: cut at the keys, map them, and join again."""
    pattern = r'"([^"]*+)"\s*+:'
    def joined(keys):
        names = F.transform(keys, lambda k: F.concat(F.lit('"'), _canonical_key(k), F.lit('":')))
        return F.array_join(F.zip_with(F.split(c, pattern), F.concat(names, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return let(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), joined)


# The patterns and characters of the two functions below are fixed values. A class that lists its characters is looked up,
# one of ranges is tried range by range.
ALNUM = ascii_letters + digits


def repair_head(c: Column) -> Column:
    """Repairs before the inner-quote step: quotes, punctuation, escapes, single-quoted keys."""
    t = F.when(is_ascii(c), c).otherwise(F.translate(c, "“”‘’，：", "\"\"'',:"))
    t = F.regexp_replace(t, r'\\([^"\\/bfnrtu])', "$1")
    return F.regexp_replace(t, r"'([a-zA-Z_][a-zA-Z0-9_]*)'(\s*):", '"$1"$2:')


def repair_tail(c: Column) -> Column:
    """Repairs after it: missing end quote, missing comma, key names, trailing commas, blank lines."""
    last = f"[{ALNUM}.!?;]"
    t = F.regexp_replace(c, rf"({last})\s*(\}}\s*[,\]\}}])", '$1"$2')
    t = F.regexp_replace(t, rf"({last})\s*(\}}\s*$)", '$1"$2')
    # Both steps change only texts with a brace after such a character.
    t = F.when(c.rlike(last + r"\s*+\}"), t).otherwise(c)
    t = F.regexp_replace(t, r'"\s*"(name|reasoning)":', '", "$1":')
    t = let(t, canonical_keys)
    t = F.regexp_replace(t, r",(\s*[}\]])", "$1")
    return F.regexp_replace(t, "\n\n+", "\n")


# A quote inside a value closes it only before a delimiter or before the next key, looked for in so many characters.
AHEAD = 19
BLANK = r"[\s\x1c-\x1f]"


def _closing_ahead() -> str:
    """What follows a quote that closes: a delimiter; or a quote with a colon, or with nothing but white space up to
    the end of the window, behind it. A regular expression can't bound a sum, so there is one branch per place of the quote.
    Most quotes are told by the next character: no branch starts with a letter or digit."""
    delimiter = BLANK + r"{0,%d}[:,}\]]" % (AHEAD - 1)
    keys = [BLANK + r'{%d}"(?:%s{0,%d}:|%s{%d}|%s{1,%d}\z)' % (a, BLANK, AHEAD - 2 - a, BLANK, AHEAD - 1 - a, BLANK, AHEAD - 1 - a) for a in range(AHEAD - 1)]
    return f"(?![{ALNUM}])(?=" + "|".join([r"[:,}\]]", delimiter, *keys]) + ")"


# A piece runs up to and with the next quote that can't close: escape pairs, other characters, and quotes that can.
PIECE = r'(?sU)(?:[^"\\]++|\\.|\\\z|"' + _closing_ahead() + r')*+(?:"|\z)'


def escape_inner_quotes(c: Column) -> Column:
    """Escape quotes inside a value, as a transducer of two states, outside and inside a value.

    A quote that can close swaps the states; any other leads inside, and is escaped if the state was inside before. So
    the state at a quote that can't close follows from the number of closing ones since the last such quote: inside
    when it is even, or odd for the first, which starts outside. The text is cut after the quotes that can't close and
    each piece is counted by itself. A quote at the end of a text can't close, so a piece that ends with a quote no
    backslash takes ends with one that can't."""
    def quotes(piece):
        plain = F.length(piece) - F.length(F.replace(piece, F.lit('"'), F.lit("")))
        paired = F.length(F.regexp_replace(piece, r'(?s)[^"\\]+|\\.|\\$', ""))
        return F.when(F.contains(piece, F.lit("\\")), paired).otherwise(plain) % 2

    def marked(piece, i):
        ends = F.endswith(piece, F.lit('"')) & (~F.endswith(piece, F.lit('\\"')) | piece.rlike(r'(?s)(?<!\\)(?:\\\\)+"\z'))
        inner = ends & (quotes(piece) == F.when(i == 0, 0).otherwise(1))
        return F.when(inner, F.concat(F.substr(piece, F.lit(1), F.length(piece) - 1), F.lit('\\"'))).otherwise(piece)
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(PIECE), F.lit(0)), marked), "")


def repaired(rows: DataFrame, column: str) -> DataFrame:
    """All repair steps on a text column, in order."""
    head = rows.withColumn(column, repair_head(F.col(column)))
    return head.withColumn(column, escape_inner_quotes(F.col(column))).withColumn(column, repair_tail(F.col(column)))


def _first(item: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(strip(item[n]) != "", strip(item[n])) for n in names], F.lit(""))


def listed_items(c: Column) -> Column:
    """array<struct<label, reasoning>> of the first non-empty list under a known key, up to five;
    null where the text is not JSON or holds no object."""
    fields = ",".join(f"{n}:string" for n in (*NAME_KEYS, *REASONING_KEYS))
    schema = "struct<" + ",".join(f"{k}:array<struct<{fields}>>" for k in LIST_KEYS) + ">"

    def picked(parsed):
        lists = F.coalesce(*[F.when(F.size(parsed[k]) > 0, parsed[k]) for k in LIST_KEYS],
                           F.array().cast(f"array<struct<{fields}>>"))
        kept = F.filter(F.slice(lists, 1, LENGTH), lambda d: d.isNotNull())
        return F.transform(kept, lambda d: let(d, lambda x: F.struct(
            _first(x, NAME_KEYS).alias("label"), _first(x, REASONING_KEYS).alias("reasoning"))))
    parsed = F.when(is_json(c) & F.startswith(strip(c), F.lit("{")), F.from_json(c, schema, STRICT))
    return let(parsed, lambda p: F.when(p.isNotNull(), picked(p)))


def complete(items: Column) -> Column:
    return F.size(F.filter(items, lambda d: (d["label"] != "") & (d["reasoning"] != "")))


def padded(items: Column) -> Column:
    blank = F.struct(F.lit("").alias("label"), F.lit("").alias("reasoning"))
    return F.slice(F.concat(items, F.array_repeat(blank, LENGTH)), 1, LENGTH)


def fallback_items(c: Column) -> Column:
    """Pairs found by pattern: objects, else key-value pairs, else a numbered list. A later
    pattern runs only while fewer than three are found and skips labels already there."""
    def pairs(pattern, first, second):
        a = F.regexp_extract_all(c, F.lit(pattern), F.lit(first))
        b = F.regexp_extract_all(c, F.lit(pattern), F.lit(second))
        rows = F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, LENGTH), lambda z: F.struct(
            strip(z["a"]).alias("label"), strip(z["b"]).alias("reasoning")))
        return F.filter(rows, lambda d: d["label"] != "")

    def extended(have, more):
        added = F.aggregate(more, have, lambda acc, d: F.when(
            F.exists(acc, lambda x: x["label"] == d["label"]), acc).otherwise(F.concat(acc, F.array(d))))
        return F.when(F.size(have) >= 3, have).otherwise(added)
    return let(pairs(OBJECT_PAIR, 1, 2), lambda one: let(
        extended(one, pairs(KEY_VALUE, 1, 2)), lambda two: F.slice(extended(two, pairs(NUMBERED, 2, 3)), 1, LENGTH)))


def mcq_answer(c: Column) -> Column:
    """struct<answer, reasoning>, or null: a JSON answer A-D, else a stated one, else a leading letter."""
    def unfenced(t):
        opened = F.regexp_replace(t, r"(?s)^```[^\n]*\n|^```", "")
        return F.when(F.startswith(t, F.lit("```")), strip(F.regexp_replace(opened, r"(?s)```\s*$", ""))).otherwise(t)

    def parsed(t):
        said = F.when(is_json(t), F.upper(strip(F.get_json_object(t, "$.answer"))))
        stated = F.upper(F.regexp_extract(t, r"(?Ui)\b(?:answer|correct)\s*(?:is|:)\s*\(?([A-D])\)?", 1))
        leading = F.regexp_extract(t, r"^([A-D])\b", 1)
        letter = F.coalesce(F.when(said.isin("A", "B", "C", "D"), said), F.when(stated != "", stated),
                            F.when(leading != "", leading))
        why = F.when(said.isin("A", "B", "C", "D"), F.coalesce(F.get_json_object(t, "$.reasoning"), F.lit(""))).otherwise(t)
        return F.when(letter.isNotNull(), F.struct(letter.alias("answer"), why.alias("reasoning")))
    return let(let(strip(c), unfenced), parsed)


def strict_items(c: Column) -> Column:
    """Labels of valid JSON with a ``diagnoses`` list, blank ones dropped; null otherwise."""
    parsed = F.when(is_json(strip(c)), F.from_json(
        strip(c), f"struct<diagnoses:array<struct<name:string,reasoning:string>>>", STRICT))
    kept = let(parsed, lambda p: F.when(p["diagnoses"].isNotNull(), F.filter(
        p["diagnoses"], lambda d: d.isNotNull() & (F.coalesce(d["name"], F.lit("")) != ""))))
    return F.transform(kept, lambda d: F.struct(d["name"].alias("label"), F.coalesce(d["reasoning"], F.lit("")).alias("reasoning")))


def balanced_array(c: Column) -> Column:
    """The text up to the bracket that closes its first one; an opening bracket is added if missing."""
    def cut(t):
        steps = F.transform(F.split(t, ""), lambda x: F.when(x == "[", 1).when(x == "]", -1).otherwise(0))
        state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

        def advance(s, step):
            depth, at = s["depth"] + step, s["at"] + 1
            done = F.when((s["end"] == 0) & (step == -1) & (depth == 0), at).otherwise(s["end"])
            return F.struct(depth.alias("depth"), at.alias("at"), done.alias("end"))
        end = F.aggregate(steps, state, advance, lambda s: s["end"])
        return let(end, lambda e: F.when(e > 0, F.substr(t, F.lit(1), e)).otherwise(t))
    opened = let(strip(c), lambda t: F.when(F.startswith(t, F.lit("[")), t).otherwise(F.concat(F.lit("["), t)))
    return let(opened, cut)


def array_items(c: Column) -> Column:
    """Up to five items of a bare list; items without a label are dropped."""
    fields = "name:string,diagnosis:string,reasoning:string,explanation:string"
    parsed = let(balanced_array(c), lambda t: F.when(is_json(t), F.from_json(t, f"array<struct<{fields}>>", STRICT)))
    rows = F.transform(F.filter(F.slice(parsed, 1, LENGTH), lambda d: d.isNotNull()), lambda d: F.struct(
        _first(d, ("name", "diagnosis")).alias("label"), _first(d, ("reasoning", "explanation")).alias("reasoning")))
    return F.coalesce(F.filter(rows, lambda d: d["label"] != ""), F.array().cast(f"array<{ITEM}>"))


def critique_text(c: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    def cut(t):
        return F.when(F.contains(t, F.lit("{")) & F.contains(t, F.lit("}")), F.regexp_extract(t, r"(?s)\{.*\}", 0))
    return let(let(strip(c), strip_thinking), cut)


def critique_items(c: Column) -> Column:
    """array<struct<label, confidence, needs_evidence, reason>> of a critique, or null."""
    fields = "diagnosis:string,diagnoses:string,name:string,diagnosis_name:string,confidence:string,needs_evidence:string,reason:string,reasoning:string"
    schema = "struct<" + ",".join(f"{k}:array<struct<{fields}>>" for k in CRITIQUE_KEYS) + ">"

    def item(d):
        sure = F.upper(F.coalesce(d["confidence"], F.lit("LOW")))
        label = F.coalesce(*[F.when(d[n] != "", d[n]) for n in ("diagnosis", "diagnoses", "name", "diagnosis_name")], F.lit(""))
        return F.struct(
            F.when(F.startswith(label, F.lit("[")), "").otherwise(label).alias("label"),
            F.when(sure.isin("HIGH", "LOW"), sure).otherwise("LOW").alias("confidence"),
            F.lower(F.coalesce(d["needs_evidence"], F.lit("true"))).isin("true", "yes", "1").alias("needs_evidence"),
            F.coalesce(*[F.when(d[n] != "", d[n]) for n in ("reason", "reasoning")], F.lit("")).alias("reason"))

    def picked(p):
        rows = F.coalesce(*[F.when(F.size(p[k]) > 0, p[k]) for k in CRITIQUE_KEYS])
        found = F.transform(F.filter(rows, lambda d: d.isNotNull()), item)
        return F.when(F.size(found) > 0, found)
    parsed = F.when(is_json(c), F.from_json(c, schema, STRICT))
    return let(parsed, lambda p: F.when(p.isNotNull(), picked(p)))


def error_class(raw: Column, message: Column) -> Column:
    """Why an output did not parse; the first rule that holds."""
    def count(mark):
        return F.length(raw) - F.length(F.replace(raw, F.lit(mark), F.lit("")))
    text, m = strip(F.coalesce(raw, F.lit(""))), F.lower(message)
    start = F.greatest(F.instr(text, F.lit("{")), F.instr(text, F.lit("["))) - 1
    preamble = ~text.rlike(r"^[{\[]") & (start > 0)
    return (F.when(text == "", "empty_output")
            .when(count("{") != count("}"), "incomplete_json").when(count("[") != count("]"), "incomplete_json")
            .when(preamble, "extra_text")
            .when(raw.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "encoding")
            .when(m.rlike("json") & m.rlike("decode") & m.rlike("expecting|extra data"), "json_syntax")
            .when(m.rlike("key|field"), "missing_fields").when(m.rlike("type"), "type_mismatch")
            .when(message.isNotNull() & (message != ""), "json_syntax").otherwise("unknown"))


def error_patterns(raw: Column, message: Column | None = None) -> Column:
    """Marks seen in a failed output and in its error message, as a list. Looking ends with the mark that decides the
    error's class; any output that isn't blank counts as possibly cut off."""
    def count(mark):
        return F.length(raw) - F.length(F.replace(raw, F.lit(mark), F.lit("")))
    text, m = strip(F.coalesce(raw, F.lit(""))), F.lower(F.lit(None).cast("string") if message is None else message)
    braces, brackets = count("{") != count("}"), count("[") != count("]")
    before = ~text.rlike(r"^[{\[]")
    preamble = before & (F.greatest(F.instr(text, F.lit("{")), F.instr(text, F.lit("["))) > 1)
    control = raw.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    decode = m.rlike("json") & m.rlike("decode")
    said = (F.when(decode & m.rlike("expecting"), "json_syntax_expecting").when(decode & m.rlike("extra data"), "json_extra_data")
            .when(m.rlike("key|field"), "missing_field").when(m.rlike("type"), "type_error"))
    marks = F.array_compact(F.array(
        F.lit("appears_truncated"), F.when(braces, "unmatched_braces"), F.when(~braces & brackets, "unmatched_brackets"),
        F.when(~(braces | brackets) & before, "extra_text_before"),
        F.when(~(braces | brackets | preamble) & (F.contains(raw, F.lit("\\u")) | F.contains(raw, F.lit("\\x"))), "escape_sequences"),
        F.when(~(braces | brackets | preamble) & control, "control_characters"),
        F.when(~(braces | brackets | preamble | control), said)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(marks)
