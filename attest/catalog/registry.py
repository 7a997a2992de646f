"""Registration of queries and their comparison SQL."""

from __future__ import annotations

import importlib
import re

from ..fixtures import SQL

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("texts", "vectors", "retrieval", "metrics", "grounding", "cohorts", "extraction", "pairs", "judging", "statistics", "voting", "files", "runs", "training")


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the fixture views that ``body`` uses in front of it."""
    views = {**SQL, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in views and name not in needed:
                visit(views[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in needed) + "\n" + body


def nudged(body: str) -> str:
    """Same nudge as ``shared.r6``."""
    return body.replace(", 6) + 0.0", " + 1.3e-10::DOUBLE, 6) + 0.0")


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    def register(function):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = with_views(nudged(sql), views)
        return function
    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__package__}.{module}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
