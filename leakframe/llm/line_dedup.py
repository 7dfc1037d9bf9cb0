"""Repeated passages of lines, found by winnowing over line hashes.

A window is the shortest run of lines with at least ``least_words`` words that
starts at some line, or that ends at some line. The line with the smallest hash
in a window is its fingerprint, so wherever a window occurs again, so does its
fingerprint, and few lines have to be joined. Around fingerprints seen twice,
matches are extended both ways, to all windows that hold them; every window
whose lines stood somewhere earlier is deleted, and windows that overlap make
one run. So each line of a run of ``least_words`` words and more that stood
earlier goes: it starts a window inside the run, or lies in the one that ends
the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.llm.scratch import place_of, stored
from leakframe.llm.tokens import _POW, _powers, hash_runs, mix, pieces, words

LEAST_WORDS = 50


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with words, of all texts: two hashes of the words, how many, number in the text, and the bounds of the texts.

    Words are lower-cased (A-Z) and white space between them does not count.
    """
    w = words(texts)
    breaks = np.flatnonzero(w.data == 0x0A)
    line = np.searchsorted(breaks, w.starts)
    text = np.searchsorted(w.texts, w.starts, side="right") - 1
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(line)))
    if not len(first):
        none = np.empty(0, np.uint64)
        return none, none, counts, first, np.zeros(len(texts) + 1, np.int64)
    within = np.arange(len(line)) - np.repeat(first, counts)
    powers = _POW if counts.max() <= len(_POW) else _powers(int(counts.max()))
    joined = lambda hashes: mix(np.add.reduceat(hashes * powers[within], first) + counts.astype(np.uint64))
    hashes, others = joined(w.hashes), joined(hash_runs(w.data, w.starts, w.ends, other=True))
    number = line[first] - np.searchsorted(breaks, w.texts[text[first]])
    return hashes, others, counts, number, np.searchsorted(text[first], np.arange(len(texts) + 1))


def windows(counts: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First lines and ends (exclusive) of all windows, ascending: the shortest from each line on, and up to each line."""
    total = np.concatenate([[0], np.cumsum(counts)])
    from_line = np.searchsorted(total, total[:-1] + least_words)
    starts = np.flatnonzero(from_line < len(total))
    stops = np.flatnonzero(total >= least_words) if least_words > 0 else np.arange(1, len(total))
    upto_line = np.searchsorted(total, total[stops] - least_words, "right") - 1
    both = np.stack([np.concatenate([starts, upto_line]), np.concatenate([from_line[starts], stops])])
    return tuple(np.unique(both, axis=1))


def _fingerprints(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            hashes, others, counts, number, bounds = lines_of(piece.column("text"))
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                h, c = hashes[a:b], counts[a:b]
                minima = sorted({i + int(h[i:e].argmin()) for i, e in zip(*windows(c, least_words), strict=True)})
                out.append((h.view(np.int64), others[a:b].view(np.int64), c.astype(np.int32), number[a:b].astype(np.int32), minima))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = [pa.array([row[k] for row in out], pa.list_(t)) for k, t in enumerate(kinds)]
            names = ["key", "place", "hashes", "others", "words", "numbers", "minima"]
            yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("place"), *columns], names)

    return run


def _content(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of lines ``first`` to ``end``."""
    out = np.empty(len(first), np.uint64)
    for k, (a, e) in enumerate(zip(first, end, strict=True)):
        powers = _POW if e - a <= len(_POW) else _powers(int(e - a))
        out[k] = np.add.reduce(hashes[a:e] * powers[: e - a])
    return mix(out + (end - first).astype(np.uint64)).view(np.int64)


def _extended(least_words: int):
    """All windows that hold a repeated fingerprint: (key, place, first and last line, 128 bits of the lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.empty(0, np.int64)] for _ in range(5)]
            for row in range(batch.num_rows):
                h, other, c, number, seeds = (batch.column(name)[row].values.to_numpy() for name in ("hashes", "others", "words", "numbers", "seeds"))
                first, end = windows(c, least_words)
                seeds = np.sort(seeds)
                at = np.searchsorted(seeds, first)
                held = (at < len(seeds)) & (seeds[np.minimum(at, len(seeds) - 1)] < end)
                first, end = first[held], end[held]
                found = (np.full(len(first), row), number[first], number[end - 1], *(_content(x.view(np.uint64), first, end) for x in (h, other)))
                for column, values in zip(out, found, strict=True):
                    column.append(values)
            rows, first, last, window, check = (pa.array(np.concatenate(column).astype(np.int64)) for column in out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(rows), batch.column("place").take(rows), first.cast(pa.int32()), last.cast(pa.int32()), window, check],
                ["key", "place", "first", "last", "window", "check"],
            )

    return run


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(place, runs): the line ranges to delete of each text that has some, as sorted, disjoint (first, last) from 0.

    ``place`` is a 128-bit hash of key and text, and lines are told equal by 128 bits too. The earliest occurrence of a window
    stays: that of the smallest key, within a text the first; null keys come
    last. Rows with the same key and text count as one text. Lines without
    words take no part, but go if they lie within a run. Null and empty texts
    and texts of fewer words than a window have no runs.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("place", place_of("key", "text"))
    kind = rows.schema["key"].dataType.simpleString()
    table = stored(
        rows.mapInArrow(_fingerprints(least_words), f"key {kind}, place binary, hashes array<long>, others array<long>, words array<int>, numbers array<int>, minima array<int>")
        .where(F.size("minima") > 0).dropDuplicates(["place"])
    )
    marks = table.select("place", F.explode("minima").alias("line"), F.col("hashes")).select("place", "line", F.get("hashes", F.col("line")).alias("hash"))
    again = marks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    seeds = marks.join(again, "hash").groupBy("place").agg(F.collect_list("line").alias("seeds"))  # at most the lines of a text
    found = stored(
        table.join(seeds, "place").select("key", "place", "hashes", "others", "words", "numbers", "seeds")
        .mapInArrow(_extended(least_words), f"key {kind}, place binary, first int, last int, window long, check long")
    )
    at = F.struct(F.col("key").isNull().alias("null"), "key", "place", "first")
    earliest = found.groupBy("window", "check").agg(F.min(at).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(earliest, ["window", "check"]).where((F.col("place") != F.col("at.place")) | (F.col("first") != F.col("at.first")))
    spans = later.groupBy("place").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))

    def merged(runs, span):
        latest = F.get(runs, F.size(runs) - 1)
        longer = F.struct(latest["first"].alias("first"), F.greatest(latest["last"], span["last"]).alias("last"))
        joins = (F.size(runs) > 0) & (span["first"] <= latest["last"] + 1)
        return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(span)))

    return stored(spans.select("place", F.aggregate("spans", F.array().cast("array<struct<first:int,last:int>>"), merged).alias("runs")))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the lines of later repeated runs, with column ``runs`` (empty where nothing was deleted).

    Texts without runs come back as they were, null included. A column ``runs``
    of ``docs`` is replaced; all others stay, whatever their names.
    """
    runs = repeated(docs, key, text, least_words).withColumnsRenamed({"place": "_place", "runs": "_runs"})
    columns = [c for c in docs.columns if c not in ("runs", "_place")]
    place = place_of(key, text)
    # Always dealt by place, so that the plan, and with it the shuffle, is the same for few runs and for many.
    joined = docs.select(*columns).withColumn("_place", place).join(runs.hint("merge"), "_place", "left")
    rest = F.array_join(
        F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.exists("_runs", lambda run: i.between(run["first"], run["last"]))), "\n"
    )
    none = F.array().cast("array<struct<first:int,last:int>>")
    out = {c: F.col(c) for c in columns} | {text: F.when(F.col("_runs").isNull(), F.col(text)).otherwise(rest)}
    return joined.select(*[e.alias(c) for c, e in out.items()], F.coalesce("_runs", none).alias("runs"))
