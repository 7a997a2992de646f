"""Sparse matrices by rows, built by hand, and their product row by row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Partial products held at once; a single row may exceed it.
PARTIALS = 1 << 21


@dataclass
class Rows:
    """Row i has the columns ``columns[starts[i]:starts[i + 1]]`` with the values beside them; a column may appear twice."""
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row_of_entries(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))


def bounds(sizes) -> np.ndarray:
    """Where each of consecutive runs starts, and the end of the last."""
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).astype(np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (sizes[i] of them) for every i, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run; an empty run has 0."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[starts[1:]] - running[starts[:-1]]


def incidence(rows: np.ndarray, columns: np.ndarray, n_rows: int) -> Rows:
    """The matrix that counts how often each (row, column) is named."""
    order = np.lexsort((columns, rows))
    rows, columns = rows[order], columns[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])])) if len(rows) else np.zeros(0, np.int64)
    return Rows(bounds(np.bincount(rows[first], minlength=n_rows)), columns[first], np.diff(np.append(first, len(rows))))


def products(a: Rows, b: Rows, n_columns: int, partials: int = PARTIALS) -> Iterator[tuple[int, Rows]]:
    """A·B by Gustavson's rule, in blocks of rows: (first row, rows of the product), columns ascending within a row.

    Row i of the product is the sum of the rows k of B that row i of A names, each times A's value. The partial
    products of a block are laid out row after row and those of one (row, column) added up."""
    per_entry = np.diff(b.starts)[a.columns]
    before = np.concatenate([[0], np.cumsum(per_entry)])[a.starts]
    first = 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(before, before[first] + partials, side="right")) - 1)
        entries = slice(a.starts[first], a.starts[last])
        sizes, named = per_entry[entries], a.columns[entries]
        places = spread(b.starts[named], sizes)
        rows = np.repeat(np.repeat(np.arange(last - first), np.diff(a.starts[first:last + 1])), sizes)
        values = np.repeat(a.values[entries], sizes) * b.values[places]
        keys = rows * np.int64(n_columns) + b.columns[places]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        added = np.add.reduceat(values[order], heads) if len(heads) else values
        rows, columns = np.divmod(keys[heads], n_columns)
        yield first, Rows(bounds(np.bincount(rows, minlength=last - first)), columns, added)
        first = last


def product(a: Rows, b: Rows, n_columns: int) -> Rows:
    """The whole of ``products``."""
    blocks = [block for _, block in products(a, b, n_columns)]
    none = [np.zeros(0, np.int64)]
    return Rows(bounds(np.concatenate([np.diff(x.starts) for x in blocks] or none)),
                np.concatenate([x.columns for x in blocks] or none), np.concatenate([x.values for x in blocks] or none))
