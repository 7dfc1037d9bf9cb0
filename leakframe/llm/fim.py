"""Fill-in-the-middle examples, cut between units by SWAR words.

A unit is a run of ASCII letters or one other code point. The UTF-8 bytes of
many texts are viewed as 64-bit words; one pass of word arithmetic marks, in the
top bit of its byte, every byte that ends a unit. Population counts of the
marked words, summed up, turn "end of the r-th unit" into a binary search for a
word and a select inside it, so no text is ever split into a list of units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.llm.tokens import buffers, pieces

# The markers, and the shares of texts (percent) left plain and, of the rest, written suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
SEED = 1

_ONES = np.uint64(0x0101010101010101)
_TOPS = _ONES << np.uint64(7)
_BYTE = np.uint64(8)


def _all(byte: int) -> np.uint64:
    return _ONES * np.uint64(byte)


def letters(words: np.ndarray) -> np.ndarray:
    """Top bits of the bytes that are A-Z or a-z. No byte's sum reaches 256, so none carries into the next."""
    folded = (words | _all(0x20)) & _all(0x7F)
    return (folded + _all(0x80 - 0x61)) & ~(folded + _all(0x80 - 0x7B)) & ~words & _TOPS


def inner(words: np.ndarray) -> np.ndarray:
    """Top bits of the continuation bytes (10xxxxxx) of UTF-8."""
    return words & ~(words << np.uint64(1)) & _TOPS


def following(marks: np.ndarray) -> np.ndarray:
    """Marks of each byte's next byte; behind the last word nothing is marked."""
    out = marks >> _BYTE
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


def below(bytes_: np.ndarray) -> np.ndarray:
    """Words whose first ``bytes_`` (0 to 7) bytes are all ones."""
    return (np.uint64(1) << (bytes_.astype(np.uint64) * _BYTE)) - np.uint64(1)


def select(marks: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place (0 to 7) of the ``rank``-th marked byte of each word, from 1."""
    upto = (marks >> np.uint64(7)) * _ONES  # byte k counts the marks of bytes 0 to k
    enough = ((upto | _TOPS) - rank.astype(np.uint64) * _ONES) & _TOPS
    return np.bitwise_count(~enough & _TOPS).astype(np.int64)


class Units:
    """Units of consecutive texts: every text starts a word, and at least one zero byte separates it from the next."""

    def __init__(self, texts: pa.Array):
        data, bounds = buffers(texts)
        lengths = np.diff(bounds)
        held = lengths // 8 + 1
        self.first = np.cumsum(held) - held  # the word each text starts at
        padded = np.zeros(int(held.sum()) * 8, np.uint8)
        shift = np.repeat(self.first * 8 - bounds[:-1], lengths)
        padded[np.arange(len(data)) + shift] = data
        words = padded.view("<u8")
        used = np.full(len(words), _TOPS)
        used[self.first + held - 1] = below(lengths % 8) & _TOPS
        letter, continued = letters(words), inner(words)
        self.ends = used & ~following(continued) & ~(letter & following(letter))
        self.starts = used & ~continued  # of code points
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])
        self.chars_upto = np.concatenate([[0], np.cumsum(np.bitwise_count(self.starts), dtype=np.int64)])
        self.count = self.upto[self.first + held] - self.upto[self.first]
        self.bytes, self.bounds = data, bounds

    def cut(self, units: np.ndarray) -> np.ndarray:
        """For each text, the byte its first ``units`` units end before."""
        out = np.zeros(len(units), np.int64)
        some = np.flatnonzero(units > 0)
        rank = self.upto[self.first[some]] + units[some]
        word = np.searchsorted(self.upto, rank) - 1  # the word that brings the sum up to the rank
        out[some] = (word - self.first[some]) * 8 + select(self.ends[word], rank - self.upto[word]) + 1
        return out

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """For each text, the code points before byte ``cut``."""
        word = self.first + cut // 8
        return self.chars_upto[word] - self.chars_upto[self.first] + np.bitwise_count(self.starts[word] & below(cut % 8))


def _written(data: np.ndarray, low: int, high: int, form: str) -> bytes:
    prefix, middle, suffix = (data[a:b].tobytes() for a, b in ((0, low), (low, high), (high, len(data))))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    for piece in pieces(batches, "text"):
        units = Units(piece.column("text"))
        draws = [piece.column(f"h{i}").to_numpy() for i in range(1, 5)]
        one, two = (d % (units.count + 1) for d in draws[:2])
        low, high = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
        before, upto = units.chars(low), units.chars(high)
        forms, texts = [], []
        for row, (a, b) in enumerate(zip(units.bounds[:-1], units.bounds[1:], strict=True)):
            data = units.bytes[a:b]
            whole = data.tobytes()
            if not whole or any(m in whole for m in marks) or draws[2][row] % 100 >= PLAIN_FROM:
                forms.append("plain")
                texts.append(whole)
            else:
                forms.append("spm" if draws[3][row] % 100 < SUFFIX_FIRST_BELOW else "psm")
                texts.append(_written(data, low[row], high[row], forms[-1]))
        plain = np.array([f == "plain" for f in forms], bool)
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("key"), pa.array(units.count), pa.array(forms, pa.string()), pa.array(before, pa.int64(), mask=plain),
                pa.array(upto - before, pa.int64(), mask=plain), pa.array(texts, pa.binary()).cast(pa.string()),
            ],
            ["key", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 that the seed and the key decide alone; a null key draws as the empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Every row's ``key``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix,
    middle) or ``plain``: the text itself, if it is empty, null or holds a
    marker, or is drawn to stay as it is; then the lengths, in code points,
    are null. Where a text is cut depends on seed, key and text alone, so
    repeated rows come out alike and a lost task gives the same rows again. No
    shuffle; a text is never cut off, whatever its length. Other columns of
    ``docs`` take no part, whatever their names.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("key", "text", *draws(F.col("key"), seed))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(_examples, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("key", key)


def restored(form: str | Column = "form", output: str | Column = "output") -> Column:
    """The exact text an example was made of. Markers can't arise where parts meet, so the first ones are the cuts."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    form = F.col(form) if isinstance(form, str) else form
    output = F.col(output) if isinstance(output, str) else output
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )

