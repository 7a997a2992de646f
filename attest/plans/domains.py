"""Domain settings: labels, anchors, prompts, parser and matcher of a kind of case."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import repair as rp, text as tx
from ..operators import prompts as pm
from ..operators.filters import SECTION_LABELS


@dataclass(frozen=True)
class Domain:
    name: str
    section_labels: tuple[str, ...]
    anchor_labels: tuple[str, ...]
    n_predictions: int
    prompt: Callable[[Column, Column | None], Column]
    parse: Callable[[Column], Column]
    accuracy_threshold: float

    def sections(self, context: Column) -> Column:
        if self.section_labels:
            return tx.labelled_sections(context, self.section_labels)
        whole = F.struct(F.lit("_full").alias("label"), tx.strip(context).alias("content"))
        return F.filter(F.array(whole), lambda s: s["content"] != "")

    def anchor(self, sections: Column) -> Column:
        if self.section_labels:
            return tx.anchor_text(sections, self.anchor_labels)
        return F.coalesce(F.get(sections, F.lit(0))["content"], F.lit(""))

    def section_rows(self, cases: DataFrame) -> DataFrame:
        rows = cases.select("case_id", F.posexplode(self.sections(F.col("context"))).alias("section_idx", "s"))
        is_anchor = F.col("s.label").isin(*self.anchor_labels) if self.section_labels else F.lit(True)
        return rows.select("case_id", "section_idx", "s.label", "s.content", is_anchor.alias("is_anchor"))


RANKED = Domain("ranked", SECTION_LABELS, ("Chief complaint", "History of present illness"), 5,
                pm.ranked_prompt, rp.strict_items, 0.80)
MCQ = Domain("mcq", (), (), 1, pm.mcq_prompt, rp.mcq_answer, 0.0)
_DOMAINS = {d.name: d for d in (RANKED, MCQ)}


def domain(name: str) -> Domain:
    if name not in _DOMAINS:
        raise ValueError(f"unknown domain {name!r}; known: {sorted(_DOMAINS)}")
    return _DOMAINS[name]
