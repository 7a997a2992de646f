"""Text functions as Columns. Each works inside one row, so no text is shuffled.

Patterns carry ``(?U)`` because the rules they state are Unicode-aware.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..operators.filters import SECTION_LABELS

# Patterns of note cleaning; the list artefacts are removed in this order.
NOTE_PLACEHOLDER = r"(?U)\b_+\b"
NOTE_ARTEFACTS = ("[': ___", "': ___", '": ___', "['", "']", '["', '"]')
NOTE_DASHED_PLACEHOLDER = r"(?U)_+\s*-\s*"
NOTE_ID_LINE = r"(?Uim)^.*\b(note_id|subject_id|hadm_id)\s*:.*\n?"
NOTE_CONCLUSION = r"(?Uims)^\s*(impression|final\s+diagnosis)\s*:.*?(?=\n\s*\n|^\S|\z)"
# Patterns of the text rules.
TOKEN = r"(?U)\b\w+\b"
SPACES = r"(?U)\s+"
NUMBERED_HEADING = r"(?U)^\s*\d+(\.\d+)*\.?\s+.+$"
NUMBERING = r"(?U)^\s*\d+(\.\d+)*\.?\s*"
SENTENCE_BEFORE_CAPITAL = r"(?U)(?<=[.!?])\s+(?=[A-Z])"
SENTENCE_ANY = r"(?U)(?<=[.!?])\s+"
FACT_BREAKS = r"(?iu), and|;|\balongside\b|\bcompounded by\b|\bfurthermore\b"
AUTHORITY = r"\[Legal Authority \d+\]:\n"
PROMPT_STOPS = r"\n\nCRITICAL|\n\nIMPORTANT|\n\nQuestion:"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed: an expression
    repeated inside an array lambda would otherwise be computed again for every element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


# The characters that are white space in Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def lines(c: Column) -> Column:
    """Lines as ``splitlines`` gives them: no empty line after a final break."""
    return let(F.split(c, LINE_BREAKS), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def chunks(c: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of whitespace-separated words, as an array of texts."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("need size >= 1 and 0 <= overlap < size")
    step = size - overlap

    def cut(w):
        n = F.size(w)
        count = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")) + 1
        pieces = F.transform(F.sequence(F.lit(0), count - 1),
                             lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(pieces)
    return let(words(c), cut)


def is_heading(line: Column) -> Column:
    """A numbered line, or an upper-case line of 3 to 120 characters."""
    bare = strip(line)
    upper = (F.upper(bare) == bare) & (F.lower(bare) != bare) & F.length(bare).between(3, 120)
    return line.rlike(NUMBERED_HEADING) | upper


def sections(c: Column) -> Column:
    """array<struct<title, body>>: a heading opens a section unless nothing was read since the
    last one, in which case it is text of that section; a section without text is dropped.

    The accepted headings follow from the pattern of heading and body lines alone: in a run of
    headings every second one is accepted, the first one if text came before the run."""
    def from_lines(ls):
        marks = F.array_join(F.transform(ls, lambda x: F.when(is_heading(x), "h").otherwise("b")), "")
        opened = F.regexp_replace(F.regexp_replace(marks, "^h", "b"), "hh", "Ab")
        flags = F.split(F.translate(opened, "h", "A"), "")
        return let(flags, lambda fl: let(
            F.filter(F.transform(fl, lambda x, i: F.when(x == "A", i + 1).otherwise(0)), lambda i: i > 0),
            lambda starts: cut(ls, starts)))

    def cut(ls, starts):
        bounds = F.concat(F.array(F.lit(0)), starts)
        ends = F.concat(F.transform(starts, lambda s: s - 1), F.array(F.size(ls)))
        spans = F.filter(F.arrays_zip(bounds.alias("s"), ends.alias("e")), lambda b: b["e"] > b["s"])
        return F.transform(spans, lambda b: section(ls, b["s"], b["e"]))

    def section(ls, start, end):
        title = F.when(start == 0, F.lit("preamble")).otherwise(strip(F.get(ls, start - 1)))
        body = F.concat(strip(F.regexp_replace(title, NUMBERING, "")), F.lit("\n"),
                        strip(F.array_join(F.slice(ls, start + 1, end - start), "\n")))
        return F.struct(title.alias("title"), body.alias("body"))
    return let(lines(c), lambda ls: F.when(F.size(ls) > 0, from_lines(ls)).otherwise(
        F.array().cast("array<struct<title:string,body:string>>")))


def dedupe_report(c: Column, label: str = "ECG machine report:") -> Column:
    """Distinct phrases, in order, of every line's report: what follows the label up to the end of its line."""
    def cleaned(line):
        at = F.instr(line, label)
        phrases = F.array_distinct(F.filter(F.transform(
            F.split(F.substr(line, at + len(label)), ";"), strip), lambda p: p != ""))
        return F.when(at > 0, F.concat(F.substr(line, F.lit(1), at - 1), F.lit(label + " "), F.array_join(phrases, "; "), F.lit("."))).otherwise(line)
    return F.array_join(F.transform(F.split(c, "\n"), cleaned), "\n")


def clean_note(c: Column) -> Column:
    """Note cleaning in its fixed order: line breaks, placeholders, id lines and conclusion
    sections, machine report, spaces."""
    t = F.replace(c, F.lit("\\n"), F.lit("\n"))
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, NOTE_PLACEHOLDER, " ")
    for artefact in NOTE_ARTEFACTS:
        t = F.replace(t, F.lit(artefact), F.lit(""))
    t = F.regexp_replace(t, NOTE_DASHED_PLACEHOLDER, "")
    t = F.regexp_replace(t, NOTE_ID_LINE, "")
    t = F.regexp_replace(t, NOTE_CONCLUSION, "")
    t = dedupe_report(t)
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, " {2,}", " "))


def clean_evidence(c: Column, bare: bool = True) -> Column:
    """Without ``bare`` a named reference that lacks its semicolon, as in a cut text, is left as it is."""
    from .entities import decode_entities
    t = let(F.regexp_replace(c, "<[^>]+>", " "), lambda x: decode_entities(x, bare))
    t = F.regexp_replace(t, "&#x?[0-9a-fA-F]+;", " ")
    return strip(F.regexp_replace(t, SPACES, " "))


def sentences(c: Column) -> Column:
    """Split after an end mark and spaces before a capital letter."""
    return F.filter(F.transform(F.split(strip(c), SENTENCE_BEFORE_CAPITAL), strip), lambda s: s != "")


def sentences_any(c: Column) -> Column:
    """Split after an end mark and spaces, whatever follows."""
    return F.filter(F.transform(F.split(strip(c), SENTENCE_ANY), strip), lambda s: s != "")


def atomic_facts(c: Column) -> Column:
    """Sentences; those longer than eight words are split further at conjunctions. A blank text has none."""
    def parts(s):
        cut = F.filter(F.transform(F.split(s, FACT_BREAKS), strip), lambda p: F.length(p) > 4)
        return F.when(F.size(words(s)) > 8, cut).otherwise(F.array(s))
    return F.flatten(F.transform(sentences(c), parts))


def labelled_sections(c: Column, labels: tuple[str, ...] = SECTION_LABELS) -> Column:
    """array<struct<label, content>> of a labelled text. A line ``label:`` opens a section and the
    lines after it belong to it; text before the first label and empty sections are dropped; a
    repeated label keeps its first place and takes the later content."""
    def opened(bare):
        found = F.lit(None).cast("string")
        for label in reversed(labels):
            found = F.when(F.startswith(bare, F.lit(label.lower() + ":")), label).otherwise(found)
        return found

    def from_rows(rows):
        starts = F.filter(F.transform(rows, lambda r, i: F.when(r["label"].isNotNull(), i + 1).otherwise(0)), lambda i: i > 0)
        return let(starts, lambda at: let(pieces(rows, at), merged))

    def pieces(rows, starts):
        ends = F.concat(F.slice(F.transform(starts, lambda s: s - 1), 2, F.greatest(F.size(starts), F.lit(1))),
                        F.array(F.size(rows)))
        spans = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda b: b["s"].isNotNull())
        return F.filter(F.transform(spans, lambda b: one(rows, b["s"], b["e"])), lambda s: s["content"] != "")

    def one(rows, s, e):
        label = F.get(rows, s - 1)["label"]
        first = strip(F.substr(F.get(rows, s - 1)["text"], F.length(label) + 2))
        later = F.transform(F.slice(rows, s + 1, e - s), lambda r: r["text"])
        content = F.array_join(F.filter(F.concat(F.array(first), later), lambda x: x != ""), " ")
        return F.struct(label.alias("label"), content.alias("content"))

    def merged(found):
        names = F.array_distinct(F.transform(found, lambda s: s["label"]))
        return F.transform(names, lambda n: F.element_at(F.filter(found, lambda s: s["label"] == n), -1))
    rows = F.transform(F.split(c, "\n"), lambda x: let(strip(x), lambda t: F.struct(
        opened(F.lower(t)).alias("label"), t.alias("text"))))
    return let(rows, from_rows)


def anchor_text(found: Column, anchors: tuple[str, ...]) -> Column:
    """``label: content`` lines of the anchor sections, in anchor order."""
    def labelled(name):
        return F.filter(found, lambda s: s["label"] == name)
    picked = [labelled(a) for a in anchors]
    return F.array_join(F.transform(F.concat(*picked), lambda s: F.concat(s["label"], F.lit(": "), s["content"])), "\n")


def other_sections(found: Column, anchors: tuple[str, ...]) -> Column:
    """``label: content`` texts of the sections that are not anchors, in order."""
    rest = F.filter(found, lambda s: ~s["label"].isin(*anchors))
    return F.transform(rest, lambda s: F.concat(s["label"], F.lit(": "), s["content"]))


def passages_from_prompt(c: Column) -> Column:
    after = let(F.split(c, AUTHORITY), lambda parts: F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))))
    return F.filter(F.transform(after, lambda p: strip(F.get(F.split(p, PROMPT_STOPS), F.lit(0)))), lambda p: p != "")


def fit_premise(premise: Column, hypothesis: Column, max_tokens: int = 512, special: int = 3) -> Column:
    """Cut the premise so that both texts fit the token budget; 100 characters if none is left."""
    budget = F.lit(max_tokens - special) - F.size(words(hypothesis))
    return let(words(premise), lambda w: let(budget, lambda left: (
        F.when(left <= 0, F.substring(premise, 1, 100)).when(F.size(w) <= left, premise)
        .otherwise(F.array_join(F.slice(w, F.lit(1), F.greatest(left, F.lit(1))), " ")))))


def clip_premise(premise: Column, limit: int = 1200) -> Column:
    """The scorer's character budget."""
    return F.substring(premise, 1, limit)


def strip_thinking(c: Column) -> Column:
    """Keep the final channel of an output with channel marks, in either spelling."""
    marker, boundary = "<|channel|>final", "assistantfinal"
    final = strip(F.substr(c, F.instr(c, F.lit(marker)) + len(marker)))
    for end in ("<|end|>", "<|return|>", "<|endoftext|>"):
        final = F.when(F.contains(final, F.lit(end)), strip(F.substring_index(final, end, 1))).otherwise(final)
    plain = strip(F.substr(c, F.instr(c, F.lit(boundary)) + len(boundary)))
    return (F.when(F.contains(c, F.lit(marker)), final)
            .when(F.startswith(c, F.lit("analysis")) & F.contains(c, F.lit(boundary)), plain).otherwise(c))


def verdict(c: Column, prompt: Column | None = None) -> Column:
    """True where the answer, without an echo of the prompt, starts with true."""
    text = c if prompt is None else F.when(
        F.startswith(c, prompt), F.substr(c, F.length(prompt) + 1)).otherwise(c)
    return F.startswith(F.lower(strip(text)), F.lit("true"))


def verdict_with_confidence(c: Column) -> tuple[Column, Column]:
    text = F.lower(strip(c))
    stated = F.regexp_extract(text, r"(?U)verdict:\s*(true|false)", 1)
    right = F.when(F.contains(text, F.lit("verdict:")), stated == "true").otherwise(F.startswith(text, F.lit("true")))
    number = F.regexp_extract(text, r"(?U)confidence:\s*([0-9.]+)", 1)
    worded = (F.when(F.contains(text, F.lit("high")), 0.9).when(F.contains(text, F.lit("medium")), 0.6)
              .when(F.contains(text, F.lit("low")), 0.3).otherwise(0.5))
    return right, F.when(number != "", F.coalesce(number.try_cast("double"), F.lit(0.5))).otherwise(worded)


def ranked_items(c: Column, heading: str, limit: int = 5) -> Column:
    """Up to five numbered or bulleted items after a heading line, until the next heading."""
    head = F.lit(heading.lower())

    def item(x):
        numbered = F.regexp_extract(x, r"(?U)^\s*(\d+)[\).:-]?\s*(.+)$", 2)
        return F.when(numbered != "", strip(numbered)).otherwise(F.regexp_replace(x, "^[- ]+|[- ]+$", ""))

    def after(ls, at):
        tail = F.slice(ls, at + 1, F.greatest(F.size(ls) - at, F.lit(1)))
        # A repeated heading line only switches capturing on again, so it yields no item.
        return let(F.filter(tail, lambda x: ~F.contains(F.lower(x), head)), until_next)

    def until_next(tail):
        stop = F.array_position(F.transform(
            tail, lambda x: F.lower(strip(x)).rlike("^(diagnoses|procedures)")), F.lit(True)).cast("int")
        body = F.when(stop > 0, F.slice(tail, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(tail)
        return F.slice(F.transform(F.filter(body, lambda x: strip(x) != ""), item), 1, limit)

    def from_lines(ls):
        at = F.array_position(F.transform(ls, lambda x: F.contains(F.lower(x), head)), F.lit(True)).cast("int")
        return let(at, lambda p: F.when(p > 0, after(ls, p)).otherwise(F.array().cast("array<string>")))
    return let(lines(c), from_lines)


def with_opener(c: Column, opener: str = "Diagnoses:") -> Column:
    return F.when(F.contains(c, F.lit(opener)), c).otherwise(F.concat(F.lit(opener + "\n"), c))


def concept_tags(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(strip(x))), lambda x: x != ""))


# Model name aliases.
MODEL_ALIASES = {
    "gemma-3-270m-it": "gemma-3-270m",
    "gemma-3-1b-it": "gemma-3-1b",
    "gemma-3-4b-it": "gemma-3-4b",
    "gemma-3-12b-it": "gemma-3-12b",
    "gemma-3-27b-it": "gemma-3-27b",
    "google/gemma-3-4b-it": "gemma-3-4b",
    "google/gemma-3-12b-it": "gemma-3-12b",
    "google/gemma-3-27b-it": "gemma-3-27b",
    "medgemma-4b-it": "medgemma-4b",
    "medgemma-27b-it": "medgemma-27b",
    "llama-3.2-1b-instruct": "llama-3.2-1b",
    "llama-3.1-8b-instruct": "llama-3.1-8b",
    "llama-3.1-70b-instruct": "llama-3.1-70b",
    "llama-3.3-70b-instruct": "llama-3.3-70b",
    "meta-llama/Llama-3.1-8B-Instruct": "llama-3.1-8b",
    "meta-llama/Llama-3.1-70B-Instruct": "llama-3.1-70b",
    "meta-llama/Llama-3.3-70B-Instruct": "llama-3.3-70b",
    "llama3-med42-8b": "med42-8b",
    "llama3-med42-70b": "med42-70b",
    "llama-4-scout-17b-16e-instruct": "llama-4-scout-17b",
    "llama-4-maverick-17b-128e-instruct": "llama-4-maverick-17b",
    "qwen-2.5-7b-instruct": "qwen-2.5-7b",
    "qwen-2.5-14b-instruct": "qwen-2.5-14b",
    "qwen-2.5-72b-instruct": "qwen-2.5-72b",
    "mistral-7b-instruct": "mistral-7b",
    "mixtral-8x7b-instruct": "mixtral-8x7b",
}


def model_key(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical model name: last path part, lower-case, known suffixes off, aliases resolved."""
    table = MODEL_ALIASES if aliases is None else aliases
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    name = F.lower(F.element_at(F.split(c, "/"), -1))
    for suffix in ("-it", "-instruct", "-chat", "-hf"):
        name = F.regexp_replace(name, suffix + "$", "")
    return F.coalesce(lookup[c], lookup[name], name)


def known_model(key: Column, known: list[str]) -> Column:
    """The known name equal to the key, else the first one that contains it or lies in it."""
    near = [F.when(F.contains(key, F.lit(k)) | F.contains(F.lit(k), key), F.lit(k)) for k in known]
    return F.when(key.isin(known), key).otherwise(F.coalesce(*near))
