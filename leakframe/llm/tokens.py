"""Words and their 64-bit hashes for whole Arrow columns of texts, in a few numpy passes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words between white space, and words of ASCII letters, digits and everything beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: glibc's call that returns freed heap pages; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20240611)
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = _RANDOM.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_OTHER_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(4096)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """Hashes of the non-empty, ascending, disjoint byte ranges ``data[starts:ends]``; ``other`` ones are independent of the first."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    powers = _POW if (longest := int(lengths.max())) <= len(_POW) else _powers(longest)
    terms = (_OTHER_BYTE if other else _BYTE)[data[within + np.repeat(starts, lengths)]] * powers[within]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


@dataclass
class Words:
    """Words of consecutive texts: byte ranges, hashes, and for each text its first word (one entry more than texts)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    texts: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the text bounds in it. Null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, kind: np.ndarray = SPACED) -> Words:
    """Words of whole texts, A-Z lower-cased, where ``kind`` says which bytes make words."""
    data, bounds = buffers(texts)
    data = _LOWER[data]
    inside = kind[data]
    before = np.empty(len(data), bool)
    before[1:] = inside[:-1]
    cuts = bounds[:-1][np.diff(bounds) > 0]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[:-1] = inside[1:]
    after[cuts[1:] - 1] = False
    after[-1:] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, hash_runs(data, starts, ends), np.searchsorted(starts, bounds), bounds)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` consecutive entries; fewer entries make one run of them all, none make none."""
    n = min(n, len(hashes))
    if not n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out += hashes[i : len(hashes) - n + 1 + i] * _GRAM[i]
    return mix(out + np.uint64(n))


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text, so that work arrays stay small; a text is never cut, and no slice is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        total = np.cumsum(np.frombuffer(pc.fill_null(pc.binary_length(column).cast(pa.int64()), 0).buffers()[1], np.int64)[: len(column)])
        cuts = np.unique(np.searchsorted(total, np.arange(size, total[-1] + size, size)))
        start = 0
        # The last boundary lies beyond the last text, whether or not that one was cut off by an earlier boundary.
        for cut in np.minimum([*(cuts + 1), len(column)], len(column)).tolist():
            if cut > start:
                yield batch.slice(start, cut - start)
                start = cut
        give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
