"""Merging two ascending arrays in independent pieces of equal work (merge path)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIECE = 4096  # ends merged by a piece


def partition(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many entries of ``a`` are among the first ``d`` merged entries, for each diagonal ``d``; of equal ones, a's come first.

    One binary search along each diagonal, all of them in step.
    """
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = open_.copy()
        first[open_] = a[middle[open_]] <= b[diagonals[open_] - 1 - middle[open_]]
        low, high = np.where(first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low


@dataclass
class Overlaps:
    """Overlapping tokens of two cuttings of the same bytes, and where both cuttings agree.

    ``a`` and ``b`` are the places of overlapping tokens, in order. Group ``g``
    holds the tokens of a below ``ends_a[g]`` and of b below ``ends_b[g]`` that
    no earlier group holds.
    """

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray


def overlaps(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> Overlaps:
    """Overlaps of tokens ending at ``a`` and at ``b`` (strictly ascending, the last ends equal).

    Each merged end that is not both a token's of a and the previous one's of b
    closes one stretch of bytes that lies in exactly one token of either side.
    Pieces are the rows of an array and never look at each other; where an end
    that both share falls on a seam, the stitching finds it afterwards.
    """
    total = len(a) + len(b)
    if not total:
        none = np.empty(0, np.int64)
        return Overlaps(none, none, none, none)
    diagonals = np.minimum(np.arange(-(-total // size) + 1) * size, total)
    from_a = partition(a, b, diagonals)
    from_b = diagonals - from_a
    row_a = np.repeat(np.arange(len(from_a) - 1), np.diff(from_a))
    row_b = np.repeat(np.arange(len(from_b) - 1), np.diff(from_b))
    merged = np.full((len(diagonals) - 1) * size, np.iinfo(np.int64).max)
    merged[row_a * size + np.arange(len(a)) - from_a[row_a]] = a << 1
    merged[row_b * size + np.diff(from_a)[row_b] + np.arange(len(b)) - from_b[row_b]] = b << 1 | 1
    merged = merged.reshape(-1, size)
    merged.sort(axis=1, kind="stable")  # two sorted runs each
    of_b = merged & 1
    b_before = np.cumsum(of_b, axis=1) - of_b
    a_before = np.arange(size) - b_before + from_a[:-1, None]
    b_before += from_b[:-1, None]
    shared = np.zeros(merged.shape, bool)
    shared[:, 1:] = merged[:, 1:] == merged[:, :-1] + 1  # an even entry and the odd one after it
    shared[:, 1:] &= of_b[:, 1:] == 1
    # Stitching: the same test between the last end of a piece and the first of the next one.
    shared[1:, 0] = (of_b[1:, 0] == 1) & (merged[1:, 0] == merged[:-1, -1] + 1)
    shared, a_before, b_before = shared.reshape(-1)[:total], a_before.reshape(-1)[:total], b_before.reshape(-1)[:total]
    return Overlaps(a_before[~shared], b_before[~shared], a_before[shared], b_before[shared] + 1)
