"""Row filters and simple projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The three-character code prefixes of the cardiac cohort.
CARDIAC_PREFIXES = (
    "I20", "I21", "I22", "I23", "I24", "I25", "I30", "I31", "I32", "I33", "I34", "I35", "I36", "I37", "I38", "I39", "I40", "I41",
    "I42", "I43", "I44", "I45", "I46", "I47", "I48", "I49", "I50", "410", "411", "412", "413", "414", "420", "421", "422", "423",
    "424", "425", "426", "427", "428")

# The labelled sections of a case text, in order, and the column each is read from.
SECTIONS = (
    ("Chief complaint", "chief_complaint"), ("History of present illness", "HPI"), ("Physical exam", "physical_exam"), ("Invasions", "invasions"),
    ("X-ray", "X-ray"), ("CT", "CT"), ("Ultrasound", "Ultrasound"), ("CATH", "CATH"), ("ECG", "ECG"), ("MRI", "MRI"), ("ECG machine report", "reports"))
SECTION_LABELS = tuple(label for label, _ in SECTIONS)
SECTION_COLUMNS = tuple(column for _, column in SECTIONS)
ID_COLUMNS = ("note_id", "subject_id", "hadm_id")


def code_labels(codes: DataFrame, prefix: str = "I") -> DataFrame:
    """Rows whose code starts with the prefix; the label is the title, else the code."""
    code = F.trim("code")
    return codes.filter(F.upper(code).startswith(prefix)).withColumn(
        "label", F.coalesce(F.when(F.trim("title") != "", F.trim("title")), code))


def with_allowed_prefix(codes: DataFrame, prefixes: tuple[str, ...] = CARDIAC_PREFIXES) -> DataFrame:
    """Rows whose first three code characters are in a fixed list; adds ``prefix``."""
    return codes.withColumn("prefix", F.substring(F.upper(F.trim("code")), 1, 3)).filter(
        F.col("prefix").isin([p.upper() for p in prefixes]))


def with_labels(cases: DataFrame, first: str = "diagnoses", second: str = "procedures") -> DataFrame:
    """Cases with an id and a label in either list."""
    size = F.coalesce(F.size(first), F.lit(0)) + F.coalesce(F.size(second), F.lit(0))
    return cases.filter((F.trim(F.col("case_id").cast("string")) != "") & (size > 0))


def case_text(ids: tuple[str, ...] = ID_COLUMNS, columns: tuple[str, ...] = SECTION_COLUMNS,
              labels: tuple[str, ...] = SECTION_LABELS) -> Column:
    """An id line, then ``Label: value`` lines; blank parts are skipped."""
    def part(label, name):
        value = F.trim(F.col(f"`{name}`").cast("string"))
        return F.when(value != "", F.concat(F.lit(f"{label}: "), F.replace(value, F.lit("|"), F.lit("; "))))
    head = F.concat_ws("; ", *[part(i, i) for i in ids])
    text = F.concat_ws("\n", F.when(head != "", head), *[part(a, b) for a, b in zip(labels, columns)])
    return F.when(text == "", "Patient details unavailable.").otherwise(text)


def full_question(prompt: str = "prompt", question: str = "question") -> Column:
    """Preamble (unless blank or the literal nan) and question."""
    head = F.trim(F.coalesce(F.col(prompt), F.lit("")))
    return F.concat_ws("\n\n", F.when((head != "") & (F.lower(head) != "nan"), head), F.trim(question))


def question_with_choices(question: Column, choices: str = "choices", letters: str = "ABCD") -> Column:
    """The question, then one ``(A) ...`` line per choice present."""
    lines = [F.when(F.col(choices)[x].isNotNull(), F.concat(F.lit(f"({x}) "), F.col(choices)[x])) for x in letters]
    return F.concat_ws("\n\n", question, F.concat_ws("\n", *lines))


def low_confidence(judgements: DataFrame, limit: int, threshold: float = 0.6) -> DataFrame:
    """The least confident judgements below a threshold, for review."""
    return judgements.filter(F.col("confidence") < threshold).orderBy("confidence", "judgement_id").limit(limit)


def significant(scored: DataFrame, score: str, threshold: float) -> DataFrame:
    return scored.filter(F.abs(score) > threshold)


def reasoning_rows(rows: DataFrame, score: str) -> DataFrame:
    """Non-empty reasoning with its length; a missing verdict counts as incorrect."""
    if score not in rows.columns:
        raise ValueError(f"score column {score!r} is missing")
    return rows.filter(F.trim("reasoning") != "").withColumn("reasoning_length", F.length("reasoning")).withColumn(
        "matched", F.coalesce("matched", F.lit(False)))


def case_slice(cases: DataFrame, start: int, end: int, order: str = "case_id") -> DataFrame:
    """Cases [start, end) of a stable order."""
    if not 0 <= start < end:
        raise ValueError("need 0 <= start < end")
    return cases.orderBy(order).offset(start).limit(end - start)


def complete_attempts(predictions: Column, minimum: int = 3) -> Column:
    """True where at least three predictions have both a label and a reasoning."""
    return F.size(F.filter(predictions, lambda p: (F.trim(p["label"]) != "") & (F.trim(p["reasoning"]) != ""))) >= minimum
