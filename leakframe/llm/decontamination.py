"""Benchmark decontamination: test phrases searched in an FM-index of every training shard.

Tasks cut the benchmark into phrases, which are stored once, in blocks of bounded
size, with the items that own them. A shard is what one task has read of the
corpus, up to ``SHARD_WORDS`` words or so of whole texts. The task indexes it,
searches the phrases block after block backwards through wavelet ranks, locates
their occurrences by sampled positions, and merges them to spans. Only spans and
the items of each text leave the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from leakframe.llm.fm_index import FMIndex
from leakframe.llm.scratch import shared_folder, stored
from leakframe.llm.tokens import ALNUM, Words, pieces, words

WINDOW = 10  # words of a test phrase
SHARD_WORDS = 400_000
PHRASE_BYTES = 16 << 20  # of phrases in a block
HELD_BLOCKS = 2  # blocks of phrases a worker keeps between shards


class Phrases:
    """A block of phrases: rows of word hashes for each length, and the items that own each."""

    def __init__(self, table: pa.Table):
        lengths = table.column("n").to_numpy()
        self.by_length = {}
        for n in np.unique(lengths):
            rows = table.filter(pa.array(lengths == n))
            hashes = np.frombuffer(b"".join(rows.column("hashes").to_pylist()), np.uint64).reshape(-1, n)
            self.by_length[int(n)] = hashes, rows.column("items").combine_chunks()


def _phrases(size: int):
    """The windows of items, each once for an item: how many words, their hashes, the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            w, items = words(piece.column("text"), ALNUM), piece.column("item").to_pylist()
            for item, a, b in zip(items, w.bounds[:-1], w.bounds[1:], strict=True):
                n = min(size, int(b - a))
                found = sorted({w.hashes[i : i + n].tobytes() for i in range(a, b - n + 1)}) if n else []
                columns = [pa.array([n] * len(found), pa.int32()), pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["n", "hashes", "item"])

    return run


def _stored_phrases(benchmark: DataFrame, item: str, text: str, window: int, phrase_bytes: int) -> str:
    """The folder that holds all phrases, different ones, a file for each block."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    windows = stored(items.distinct().mapInArrow(_phrases(window), "n int, hashes binary, item string"))
    size = windows.agg(F.coalesce(F.sum(F.octet_length("hashes") + F.octet_length("item")), F.lit(0))).first()[0]
    folder = shared_folder(benchmark.sparkSession)
    owned = windows.groupBy("n", "hashes").agg(F.collect_set("item").alias("items"))
    owned.repartition(max(1, -(-size // phrase_bytes)), "n", "hashes").write.parquet(folder)
    return folder


_blocks: dict[str, Phrases] = {}


def _read(folder: str) -> Iterator[Phrases]:
    """The blocks of a folder of phrases, one at a time; the last ones read are kept."""
    found, inside = pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder) if re.match("[a-z0-9]+:", folder) else f"file://{folder}")
    for path in sorted(f.path for f in found.get_file_info(pa.fs.FileSelector(inside)) if f.base_name.startswith("part-")):
        if path not in _blocks:
            while len(_blocks) >= HELD_BLOCKS:
                del _blocks[next(iter(_blocks))]
            with found.open_input_file(path) as source:
                _blocks[path] = Phrases(pa.parquet.read_table(source))
        yield _blocks[path]


class Shard:
    """The index of a run of texts; ``breaks`` are the texts' first words."""

    def __init__(self, hashes: np.ndarray, breaks: np.ndarray):
        self.known, codes = np.unique(hashes, return_inverse=True)
        # Symbol 1 stands between texts, so that no phrase reaches from one into the next.
        at = np.arange(len(hashes)) + np.searchsorted(breaks, np.arange(len(hashes)), side="right") - 1
        sequence = np.ones(len(hashes) + len(breaks), np.int64)
        sequence[at] = codes + 2
        self.index = FMIndex(sequence, len(self.known) + 2)
        self.origin = np.zeros(len(sequence), np.int64)
        self.origin[at] = np.arange(len(hashes))

    def occurrences(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence of phrases of one length."""
        codes = np.minimum(np.searchsorted(self.known, rows), len(self.known) - 1)
        here = np.flatnonzero((self.known[codes] == rows).all(1))  # a word the shard lacks rules a phrase out
        low, high = self.index.search(codes[here] + 2)
        hits = high - low
        places = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
        return self.origin[self.index.locate(places)], np.repeat(here, hits)


def _found(hashes: np.ndarray, bounds: np.ndarray, folder: str) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words of a shard's texts are hit, and the items of each text that has any."""
    hit, items = np.zeros(len(hashes) + 1, np.int64), {}
    if len(hashes):
        shard = Shard(hashes, bounds[:-1])
        for phrases in _read(folder):
            for n, (rows, owners) in phrases.by_length.items():
                first, phrase = shard.occurrences(rows)
                np.add.at(hit, first, 1)
                np.add.at(hit, first + n, -1)
                # A phrase that stands often in a text, or that many items own, counts once for a text before its owners are looked up.
                text = np.searchsorted(bounds, first, side="right") - 1
                for t, p in np.unique(np.stack([text, phrase], 1), axis=0).tolist():
                    items.setdefault(t, set()).update(owners[p].as_py())
    return np.cumsum(hit)[:-1] > 0, items


def _search(folder: str, shard_words: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[Words]]]:
        held, found, size = [], [], 0
        for piece in pieces(batches, "text"):
            held.append(piece)
            found.append(words(piece.column("text"), ALNUM))
            size += len(found[-1].hashes)
            if size >= shard_words:
                yield held, found
                held, found, size = [], [], 0
        if held:
            yield held, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, found in shards(batches):
            all_words = np.concatenate([w.hashes for w in found])
            offsets = np.cumsum([0, *(len(w.hashes) for w in found)])
            bounds = np.concatenate([*(w.bounds[:-1] + o for w, o in zip(found, offsets[:-1], strict=True)), offsets[-1:]])
            hit, owners = _found(all_words, bounds, folder)
            row = 0
            for piece, w, offset in zip(held, found, offsets[:-1], strict=True):
                items, spans = [], []
                for a, b, base in zip(w.bounds[:-1], w.bounds[1:], w.texts[:-1], strict=True):
                    ours = hit[offset + a : offset + b]
                    items.append(sorted(owners.get(row, ())))
                    spans.append(_spans(w, a, b, ours, base) if ours.any() else [])
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        *[piece.column(c) for c in piece.schema.names], pa.array(np.diff(w.bounds)), pa.array(items, pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    [*piece.schema.names, *MADE],
                )

    return run


def _spans(w: Words, a: int, b: int, hit: np.ndarray, base: int) -> list[tuple[int, int, int, int]]:
    """Runs of hit words of one text: first and last word, and their bytes in the text."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(x), int(y - 1), int(w.starts[a + x] - base), int(w.ends[a + y - 1] - base)) for x, y in edge.reshape(-1, 2)]


SPAN_TYPE = ArrayType(StructType([StructField(name, LongType()) for name in ("first", "last", "start", "end")]))
MADE = ["n_words", "items", "spans"]


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_words: int = SHARD_WORDS, phrase_bytes: int = PHRASE_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ids with an occurring window, as sorted strings) and ``spans``.

    Spans are merged runs of hit words: first and last word, and their UTF-8
    bytes [start, end). Every row comes back, without a shuffle. Null and empty
    texts have no words; items without words are never found, an item of fewer
    words than a window is one window; rows of the same item id are one item,
    a null id is the empty string. Columns of these names are replaced.
    """
    made = [*MADE, "n_hit"]
    folder = _stored_phrases(benchmark, item, item_text, window, phrase_bytes)
    out = docs.select(*[c for c in docs.columns if c not in made and c != text], F.col(text).cast("string").alias("text"))
    schema = StructType(list(out.schema.fields)).add("n_words", "long").add("items", ArrayType(StringType())).add("spans", SPAN_TYPE)
    out = out.mapInArrow(_search(folder, shard_words), schema)
    return out.select(
        *[F.col("text").alias(text) if c == text else c for c in docs.columns if c not in made],
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1).alias("n_hit"),
        "items", "spans",
    )


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """``scan`` results with the spans cut out of the texts; what stood around a span is parted by a line break."""
    data = F.col(text).cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda span: span["end"]))
    ends = F.concat(F.transform("spans", lambda span: span["start"]), F.array(F.octet_length(text).cast("long")))
    parts = F.zip_with(begins, ends, lambda begin, end: F.substring(data, (begin + 1).cast("int"), (end - begin).cast("int")).cast("string"))
    left = F.array_join(F.filter(parts, lambda part: part.rlike("[^\\x20\\x09-\\x0D]")), "\n")
    return found.withColumn(text, F.when(F.size("spans") > 0, left).otherwise(F.col(text)))
