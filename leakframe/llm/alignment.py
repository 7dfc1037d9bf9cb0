"""Alignment of two tokenizers over the same bytes.

The ends of both tokenizers' tokens are merged, many texts at a time, in pieces
of equal work (``merge_path``). Where both end, a group is complete; every
stretch between two ends links one token of either side. How many texts of the
corpus hold a link is counted in two steps: blocks of texts first, in the tasks
that cut them, then the blocks' sums by pair. The totals go back to the blocks
that asked for them, so that no link row is ever shuffled by itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.llm.merge_path import overlaps
from leakframe.llm.piece_bpe import send
from leakframe.llm.scratch import stored
from leakframe.llm.tokens import pieces

BLOCK_BYTES = 16 << 20  # text of a block; one text at least
PAIR_BYTES, TASK_BYTES = 12, 256 << 20  # of a text's links at most, and of those that a task of the second pass takes, or so
SLICE = 1 << 19  # bytes of text cut into tokens at a time
LONG = 1 << 18  # characters from which on a text goes to the byte-level tokenizer in parts

# Fixed value: the published pattern that byte-level BPE cuts texts by before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts of these characters are cut by ``PATTERN`` alike in any Unicode version, so the faster encoder may take them.
_LATIN = re.compile("[\x00-\u036f]*")

#: Between a letter and a space before a letter, the byte-level tokenizer starts anew whatever comes before.
_FRESH = re.compile("[A-Za-z](?= [A-Za-z])")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def _parts(text: str) -> list[str]:
    """``text`` cut where the byte-level tokenizer cuts in any case, into parts of about ``LONG`` characters."""
    out, start = [], 0
    while len(text) - start > LONG and (found := _FRESH.search(text, start + LONG)):
        out.append(text[start : found.end()])
        start = found.end()
    return [*out, text[start:]]


class ByteTokens:
    """A byte-level BPE: ids and bytes of its tokens."""

    def __init__(self, data: bytes):
        self.model = tokenizers.Tokenizer.from_buffer(data)
        self.model.encode_special_tokens = True
        # The published byte alphabet: printable Latin-1 characters are themselves, all others follow from 256 on.
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(kept))}
        self.bytes = [b""] * self.model.get_vocab_size()
        for token, i in self.model.get_vocab().items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

        self.fast = self._fast(json.loads(data))

    def _fast(self, file: dict) -> tiktoken.Encoding | None:
        """A faster encoder of the same vocabulary, if its ids are in the order of its merges and nothing else is done to texts."""
        special = {t["id"] for t in file["added_tokens"]}
        ranks = {token: i for i, token in enumerate(self.bytes) if i not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in file["model"]["merges"]]
        in_order = [file["model"]["vocab"][m] for m in merged] == list(range(256, 256 + len(merged)))
        cut = file["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True) and file["normalizer"] is None
        if not (plain and in_order and len(ranks) == 256 + len(merged)):
            return None
        return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [_parts(" " + t) for t in texts]
        fast = [self.fast is not None and _LATIN.fullmatch(t) is not None for t in texts]
        slow = iter(self.model.encode_batch_fast([p for part, f in zip(parts, fast, strict=True) if not f for p in part], add_special_tokens=False))
        return [[i for p in part for i in (self.fast.encode_ordinary(p) if f else next(slow).ids)] for part, f in zip(parts, fast, strict=True)]


class PieceTokens:
    """A sentencepiece model with byte fallback: ids and bytes of its pieces."""

    def __init__(self, data: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            found = _BYTE_PIECE.fullmatch(piece) if self.model.is_byte(i) else None
            self.bytes.append(bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Both tokenizers, and what alignments are written with."""

    def __init__(self, one: bytes, other: bytes):
        self.a, self.b = ByteTokens(one), PieceTokens(other)
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        self.width = len(self.b.bytes)
        # Decimal ids with each separator; a fixed width, padded with zero bytes.
        self.comma, self.bar, self.semicolon = (np.array([f"{i}{s}".encode() for i in range(max(len(self.a.bytes), self.width))]) for s in ",|;")

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none for texts that are empty or whose bytes are not given back by either side."""
        sides = []
        for side in (self.a, self.b):
            ids = side.encode(texts)
            for t, (text, found) in enumerate(zip(texts, ids, strict=True)):
                if not text or b"".join(map(side.bytes.__getitem__, found)) != b" " + text.encode():
                    ids[t] = []
            sides.append(ids)
        whole = [bool(x and y) for x, y in zip(*sides, strict=True)]
        return tuple([np.array(i if w else [], np.int64) for i, w in zip(ids, whole, strict=True)] for ids in sides)

    def align(self, texts: list[str]) -> Iterator:
        return Aligned(self, *self.tokens(texts))


class Aligned:
    """Links and groups of some texts, merged as one long text: every text ends on an end that both sides share."""

    def __init__(self, by: Aligner, ids_a: list[np.ndarray], ids_b: list[np.ndarray]):
        self.by = by
        bounds = lambda ids: np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        self.bounds_a, self.bounds_b = bounds(ids_a), bounds(ids_b)
        self.a, self.b = (np.concatenate([*ids, np.empty(0, np.int64)]) for ids in (ids_a, ids_b))
        ends = (np.cumsum(size[ids]) for size, ids in zip(by.sizes, (self.a, self.b), strict=True))
        self.found = overlaps(*ends)
        self.n_a, self.n_b = np.diff(self.bounds_a), np.diff(self.bounds_b)
        self.group_bounds = np.searchsorted(self.found.ends_a, self.bounds_a, "right")
        self.group_bounds[0] = 0
        self.link_bounds = np.searchsorted(self.found.a, self.bounds_a)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each text, how often it links them, and the bounds of the texts."""
        codes = self.a[self.found.a] * self.by.width + self.b[self.found.b]
        text = np.repeat(np.arange(len(self.n_a)), np.diff(self.link_bounds))
        order = np.lexsort((codes, text))
        codes, text = codes[order], text[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        return codes[first], np.diff(np.append(first, len(codes))), np.searchsorted(text[first], np.arange(len(self.n_a) + 1))

    def written(self) -> list[bytes]:
        """Groups of each text as ``a1,a2|b1;a3|b2,b3``; the empty string for texts without tokens."""
        ends_a, ends_b = self.found.ends_a, self.found.ends_b
        out = np.empty(len(self.a) + len(self.b), self.by.comma.dtype)
        place = np.arange(len(self.a)) + np.concatenate([[0], ends_b])[np.searchsorted(ends_a, np.arange(len(self.a)), "right")]
        out[place] = self.by.comma[self.a]
        out[place[ends_a - 1]] = self.by.bar[self.a[ends_a - 1]]
        place = np.arange(len(self.b)) + ends_a[np.searchsorted(ends_b, np.arange(len(self.b)), "right")]
        out[place] = self.by.comma[self.b]
        out[place[ends_b - 1]] = self.by.semicolon[self.b[ends_b - 1]]
        bounds = self.bounds_a + self.bounds_b
        return [out[x:y].tobytes().translate(None, b"\0")[:-1] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate([*pairs, np.empty(0, np.int64)]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([*counts, np.empty(0, np.int64)]), len(found)).astype(np.int64)


_ALIGNERS: dict[tuple[int, int], Aligner] = {}


def _loaded(one: bytes, other: bytes) -> Aligner:
    mark = hash(one), hash(other)
    if mark not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[mark] = Aligner(one, other)
    return _ALIGNERS[mark]


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _cut(one, other, kind: pa.DataType, with_groups: bool):
    """Rows of texts with their pairs, and after every block's texts one row with the block's pairs and their texts."""

    def block_row(schema: pa.Schema, block: int, found: list) -> pa.RecordBatch:
        pairs, texts = _summed(*map(list, zip(*found, strict=True)))
        bounds = np.array([0, len(pairs)])
        values = {"block": pa.array([block], pa.int64()), "pairs": _lists(pairs, bounds, kind), "times": _lists(texts, bounds, pa.int64())}
        return pa.RecordBatch.from_arrays([values.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _loaded(one.value, other.value)
        block = TaskContext.get().partitionId() << 32
        found, size, schema = [], 0, None
        for piece in pieces(batches, "text", SLICE):
            texts = piece.column("text").to_pylist()
            aligned = by.align(texts)
            pairs, times, bounds = aligned.pairs()
            written = aligned.written()
            out = pa.RecordBatch.from_arrays(
                [
                    piece.column("key"), pa.array(np.full(len(texts), block)), pa.array(aligned.n_a), pa.array(aligned.n_b),
                    pa.array(np.diff(aligned.group_bounds)), pa.array(np.diff(aligned.link_bounds)),
                    pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in written], pa.string()),
                    pa.array([w.decode() if with_groups else None for w in written], pa.string()),
                    _lists(pairs, bounds, kind), _lists(times, bounds, pa.int64()),
                ],
                ["key", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"],
            )
            schema = out.schema
            yield out
            found.append(_summed([pairs], [np.ones(len(pairs), np.int64)]))
            size += sum(map(len, texts))
            if size >= BLOCK_BYTES:
                yield block_row(schema, block, found)
                found, size, block = [], 0, block + 1
            elif len(found) >= 16:
                found = [_summed(*map(list, zip(*found, strict=True)))]
        if found:
            yield block_row(schema, block, found)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts, each block's after the totals of the pairs it asked for, with ``n_best`` and ``count_sum``."""
    current, parts, totals = None, [], None
    for batch in batches:
        blocks, rows = batch.column("block").to_numpy(), batch.column("pair").is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (rows[1:] != rows[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
            if a == b:
                continue
            run = batch.slice(a, b - a)
            if blocks[a] != current:
                current, parts, totals = blocks[a], [], None
            if not rows[a]:
                parts.append([run.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")])
                continue
            if totals is None:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
                order = np.argsort(columns[0])
                totals = [c[order] for c in columns]
            lists = run.column("pairs")
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            at = np.searchsorted(totals[0], lists.flatten().to_numpy())
            times = run.column("times").flatten().to_numpy()
            sums = [np.concatenate([[0], np.cumsum(times * totals[k][at])])[bounds] for k in (2, 1)]
            made = {"n_best": pa.array(np.diff(sums[0]).astype(np.int64)), "count_sum": pa.array(np.diff(sums[1]).astype(np.int64))}
            names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
            yield pa.RecordBatch.from_arrays([made[c] if c in made else run.column(c) for c in names], names)


def align(docs: DataFrame, byte_model: str, piece_model: str, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """Every row's ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` and ``groups``.

    A is the byte-level BPE of the file ``byte_model``, over a space and the
    text; B the sentencepiece model of the file ``piece_model``, which adds the
    space itself; strings of special tokens are plain text to both. ``groups``
    writes the ids between shared ends as ``a1,a2|b1;a3|b2,b3`` (null unless
    ``with_groups``), ``groups_sha256`` is its digest. A link's count is the
    number of rows, repeated ones included, that hold its id pair linked;
    ``n_best`` counts the links that no other pair of their A id exceeds,
    ``count_sum`` sums over links. Null and empty texts, and texts that either
    side does not give back byte for byte, have no tokens: zeros, and the empty
    string for digest and groups. Other columns of ``docs`` take no part.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    one, other = send(docs.sparkSession, byte_model), send(docs.sparkSession, piece_model)
    by = Aligner(one.value, other.value)
    small = len(by.a.bytes) * by.width < 1 << 31
    pair, key_type = "int" if small else "long", rows.schema["key"].dataType.simpleString()
    schema = (
        f"key {key_type}, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
        f"pairs array<{pair}>, times array<long>"
    )
    table = stored(rows.mapInArrow(_cut(one, other, pa.int32() if small else pa.int64(), with_groups), schema))
    texts = table.where("n_a is not null")
    asked = (
        table.where("n_a is null").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("of"))
        .select("block", F.col("of.pairs").alias("pair"), F.col("of.times").alias("texts"))
    )
    totals = stored(asked.groupBy("pair").agg(F.sum("texts").alias("count")))
    of_a = F.floor(F.col("pair") / by.width).alias("a")
    best = totals.groupBy(of_a).agg(F.max("count").alias("most"))
    totals = totals.withColumn("a", of_a).join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    told = asked.select("block", "pair").join(totals, "pair").select("block", "pair", "count", "best")
    # A task's share of the texts does not grow with their number.
    size = texts.agg(F.coalesce(F.sum(F.col("n_links") * PAIR_BYTES), F.lit(0))).first()[0]
    tasks = max(-(-size // TASK_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = texts.unionByName(told, allowMissingColumns=True).repartition(tasks, "block").sortWithinPartitions("block", F.col("pair").isNull())
    out = both.mapInArrow(_counted, f"key {key_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")
    return out.withColumnRenamed("key", key)
