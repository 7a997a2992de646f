"""Ranks of byte windows by prefix doubling inside a text, and the windows' content-chosen anchors (numpy)."""

from __future__ import annotations

import functools

import numpy as np

# Lengths at which positions are ranked; each rank comes from the pair of ranks STEP bytes apart.
PART, HALF, LENGTH, STEP = 20, 35, 50, 15
# Window starts handled at once: arrays stay in cache, and a text of any length takes the same memory.
SLICE = 1 << 16
PLACE = np.uint64((1 << 17) - 1)


@functools.cache
def letters() -> np.ndarray:
    return np.random.default_rng(1).integers(0, 1 << 64, 256, dtype=np.uint64)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of a window from the ranks of its two parts: 64 bits, equal for equal pairs."""
    out = left * np.uint64(0x9E3779B97F4A7C15)
    out += right
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def part_ranks(data: np.ndarray) -> np.ndarray:
    """Ranks of all windows of PART bytes: of 1, 2, 4, 8 and 16 bytes by sums of products, then of 20."""
    rank = letters()[data]
    for span, factor in ((1, 0x9E3779B97F4A7C17), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779FB), (8, 0xD6E8FEB86659FD93)):
        rank = rank[:-span] * np.uint64(factor) + rank[span:]
    return joined(rank[:-4], rank[4:])


def half_ranks(part: np.ndarray) -> np.ndarray:
    return joined(part[:-STEP], part[STEP:])


def window_ranks(half: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each of the windows of LENGTH bytes: the two orders of its pair of ranks."""
    left, right = half[starts], half[starts + STEP]
    return joined(left, right), joined(right, left) >> np.uint64(32)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        step = min(span, width - span)
        values = np.minimum(values[:len(values) - step], values[step:])
        span += step
    return values


def crossing(ends: np.ndarray, skipped: np.ndarray) -> np.ndarray:
    """For texts that lie one after the other and end at ``ends``: which window starts lie too near the end of their
    text, or in a text that is skipped."""
    total = int(ends[-1]) if len(ends) else 0
    marks = np.zeros(total + 1, dtype=np.int8)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = ends > starts
    np.add.at(marks, np.where(skipped, starts, np.maximum(starts, ends - LENGTH + 1))[full], 1)
    np.add.at(marks, ends[full], -1)
    return np.cumsum(marks, dtype=np.int8)[:-1] > 0


def anchored(data: np.ndarray, ends: np.ndarray, skipped: np.ndarray):
    """The anchors of all windows, slice by slice: the slice's first byte, the ranks of its parts, and per run of
    windows with one anchor the first and last window and the anchor, counted from the slice's first byte.

    A window's anchor is its part of least rank, the first if there are several, so equal windows have equal
    anchors at equal places."""
    if len(data) < LENGTH:
        return
    outside = crossing(ends, skipped)
    for at in range(0, len(data) - LENGTH + 1, SLICE):
        stop = min(at + SLICE, len(data) - LENGTH + 1)
        rank = part_ranks(data[at:stop + LENGTH - 1])
        marked = (rank & ~PLACE) | np.arange(len(rank), dtype=np.uint64)
        place = (sliding_least(marked, LENGTH - PART + 1) & PLACE).astype(np.int64)
        place[outside[at:stop]] = -1
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        real = place[first] >= 0
        yield at, rank, first[real], last[real], place[first[real]]
