"""Near-duplicate texts by SetSketch registers.

A text's set of word shingles is sketched into registers: for each register,
every shingle draws an exponential number from its hash, and the smallest is
kept on an exponentially spaced, truncated scale. Registers of a union are the
larger ones of its parts, and two sets agree in a register about as often as
their Jaccard similarity says. Bands of registers propose pairs, the registers
of both sides estimate the similarity by maximum likelihood, and what is not
refuted is verified on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.llm.components import components
from leakframe.llm.scratch import place_of, stored
from leakframe.llm.tokens import SPACED, grams, pieces, words

BANDS, ROWS = 32, 4  # a pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 5e-8
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_534  # scale of the registers, which fit 16 bits
SIMILARITY = 80  # percent
SHINGLE_WORDS = 5
REFUTED = 16.0  # log-likelihood by which the best similarity must beat the least wanted one
FEW_EQUAL = 0.4  # share of equal registers below which a pair's likelihood need not be worked out: it is refuted anyway
BLOCK = 1024  # members of a bucket compared at a time, and
BLOCK_BYTES = 16 << 20  # bytes of their sketches and sets; one member at least

_RANDOM = np.random.default_rng(77)
_FACTORS = _RANDOM.integers(0, 2**64, REGISTERS, np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**64, REGISTERS, np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set of hashes. ``np.maximum`` of two sketches is the sketch of the union."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 512):
        np.minimum(least, (shingles[start : start + 512, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    drawn = -np.log1p(-(least.astype(float) + 1) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(drawn, 1e-300)) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def agreement(similarity: np.ndarray | float, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chances that a register of sets of these sizes is larger in the first, larger in the second, or equal."""
    union = (one + other) / (1 + similarity)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p((union - other) / union), p((union - one) / union)
    return up, down, np.maximum(1 - up - down, 1e-12)


def refuted(first: np.ndarray, second: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int = SIMILARITY) -> np.ndarray:
    """Where the registers of pairs (rows) speak clearly against the wanted similarity.

    The joint likelihood of "larger, smaller, equal" given both set sizes is
    compared at the wanted similarity and at its best below that.
    """
    up, down = (first > second).sum(1), (first < second).sum(1)
    equal = REGISTERS - up - down
    one, other = one.astype(float), other.astype(float)
    bound = np.minimum(one, other) / np.maximum(np.maximum(one, other), 1)  # no pair is more similar than its sizes

    def likelihood(similarity: np.ndarray) -> np.ndarray:
        a, b, c = agreement(np.minimum(similarity, bound), one, other)
        return up * np.log(np.maximum(a, 1e-12)) + down * np.log(np.maximum(b, 1e-12)) + equal * np.log(c)

    wanted = likelihood(np.full(len(one), percent / 100))
    best = np.max([likelihood(np.full(len(one), s / 100)) for s in range(5, percent, 5)], axis=0)
    return (100 * np.minimum(one, other) < percent * np.maximum(one, other)) | (best - wanted > REFUTED)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            w = words(piece.column("text"), SPACED)
            counts, marks, registers = [], [], []
            for first, end in zip(w.bounds[:-1], w.bounds[1:], strict=True):
                found = np.unique(grams(w.hashes[first:end], size))
                counts.append(len(found))
                marks.append(hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest())
                registers.append(sketch(found).tobytes() if len(found) else b"")
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), piece.column("place"), pa.array(counts, pa.int64()), pa.array(marks, pa.string()), pa.array(registers, pa.binary())],
                ["key", "place", "n_shingles", "mark", "registers"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            w = words(piece.column("text"), SPACED)
            found = [np.unique(grams(w.hashes[a:b], size)).view(np.int64) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
            bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])])
            sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            marks = [hashlib.blake2b(f.tobytes(), digest_size=16).hexdigest() for f in found]
            same = pa.array([a == b for a, b in zip(marks, piece.column("mark").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([piece.column("node"), sets], ["node", "shingles"]).filter(same)

    return run


def _band_keys(registers: Column) -> Column:
    width = 2 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(registers, i * width + 1, F.lit(width))))


def _unrefuted(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                side = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16).reshape(-1, REGISTERS)  # noqa: E731, B023
                keep = ~refuted(side("registers_a"), side("registers_b"), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
                kept = batch.select(["a", "b"]).filter(pa.array(keep))
                yield kept

    return run


TILE = ("bucket", "low", "high")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole (bucket, low, high) groups of sorted batches: rows, and where groups begin and end."""
    held = None
    for batch in batches:
        table = batch if held is None else pa.concat_batches([held, batch])
        if table.num_rows:
            keys = [table.column(c).to_numpy() for c in TILE]
            cuts = np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1])
            if cuts[-1]:
                yield table.slice(0, cuts[-1]), cuts
            held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


class _Tile:
    """Members of two blocks of a bucket, to be compared across components."""

    def __init__(self, table: pa.RecordBatch, percent: int):
        self.node, self.root, self.tile, self.band = (table.column(c).to_numpy() for c in ("node", "root", "tile", "band"))
        self.low, self.high, self.sizes = (table.column(c).to_numpy() for c in ("low", "high", "n_shingles"))
        self.registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.percent = percent

    def others(self, a: int, b: int) -> Iterator[tuple[int, np.ndarray]]:
        """For rows of a group, the rows to compare them with: a pair that shares an earlier band meets there."""
        rows = np.arange(a, b)
        left, right = rows[self.tile[a:b] == self.low[a]], rows[self.tile[a:b] == self.high[a]]
        for i in left:
            j = right[(self.root[right] != self.root[i]) & ((self.node[right] > self.node[i]) | (self.low[a] != self.high[a]))]
            if len(j):
                equal = self.registers[j] == self.registers[i]
                first = equal.reshape(-1, BANDS, ROWS).all(2).argmax(1)
                j = j[(first == self.band[a]) & (equal.sum(1) >= int(FEW_EQUAL * REGISTERS))]
                if len(j):
                    yield i, j

    def open(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return ~refuted(self.registers[one], self.registers[other], self.sizes[one], self.sizes[other], self.percent)


def _alike(percent: int):
    """Members of tiles that their sketches leave open to a link into another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _tiles(batches):
            tile, marked = _Tile(table, percent), np.zeros(table.num_rows, bool)
            ones, others, held = [], [], 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for i, j in tile.others(a, b):
                    ones.append(np.full(len(j), i))
                    others.append(j)
                    held += len(j)
                if held and (held >= 65_536 or b == cuts[-1]):
                    one, other = np.concatenate(ones), np.concatenate(others)
                    keep = tile.open(one, other)
                    marked[one[keep]] = marked[other[keep]] = True
                    ones, others, held = [], [], 0
            yield table.select([*TILE, "band", "tile", "node", "root"]).filter(pa.array(marked))

    return run


def _joining(percent: int):
    """Verified links inside tiles, of rows with full sets; one link is enough to join two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _tiles(batches):
            tile, sets = _Tile(table, percent), table.column("shingles")
            links = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = {i: sets[i].values.to_numpy() for i in range(a, b)}
                for i, j in tile.others(a, b):
                    for k in j[tile.open(np.full(len(j), i), j)]:
                        if tile.root[i] != tile.root[k]:
                            both = len(np.intersect1d(own[i], own[k], assume_unique=True))
                            if 100 * both >= percent * (len(own[i]) + len(own[k]) - both):
                                links.append((int(tile.node[i]), int(tile.node[k])))
                                tile.root = np.where(tile.root == tile.root[k], tile.root[i], tile.root)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _sketched(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sketches don't refute."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"registers_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(_unrefuted(percent), "a long, b long")


def _ordered(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _with_roots(members: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links)
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _in_tiles(members: DataFrame) -> DataFrame:
    """Members of buckets, once for every pair of blocks (low, high) that they are compared in.

    A component that fills more than a block of its bucket is cut into blocks of
    its own, the small ones share blocks. No pair of blocks lies inside one
    component, so a large group is copied towards foreign blocks only.
    """
    full = lambda rows, size: F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES))
    size = F.sum(2 * REGISTERS + 8 * F.col("n_shingles"))
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("rows"), size.alias("size")).withColumn("blocks", full(F.col("rows"), F.col("size")))
    shared = parts.where("blocks = 1").groupBy("bucket").agg(full(F.sum("rows"), F.sum("size")).alias("shared"))
    own = F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("blocks")))
    tile = F.when(F.col("blocks") > 1, own).otherwise(F.pmod(F.xxhash64("root"), F.col("shared")))
    placed = stored(
        members.join(parts.select("bucket", "root", "blocks").join(shared, "bucket", "left"), ["bucket", "root"])
        .select("bucket", "band", "node", "root", tile.alias("tile"))
    )
    tiles = placed.groupBy("bucket", F.col("tile").alias("low")).agg(F.min("root").alias("least"), F.max("root").alias("largest"))
    other = tiles.select("bucket", F.col("low").alias("high"), F.col("least").alias("other_least"), F.col("largest").alias("other_largest"))
    pairs = tiles.join(other, "bucket").where("low <= high and least(least, other_least) <> greatest(largest, other_largest)").select("bucket", "low", "high")
    sides = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("low", "high"))))
    return placed.join(sides, ["bucket", "tile"]).select("bucket", "low", "high", "band", "tile", "node", "root")


def _links(nodes: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Verified links that connect whatever is connected through pairs that share a band.

    Two rounds link the members of each bucket to one of them, which joins
    groups of near copies at a cost in proportion to their size. Then members
    still in different components are compared by their sketches, and what
    these leave open by full sets, inside tiles of bounded size. Pairs are made
    and judged in the task; only links that join components leave it.
    """
    bands = nodes.select("node", F.posexplode(_band_keys(F.col("registers"))).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = stored(bands.join(shared, "bucket"))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "mark", "place")
    sets = stored(
        texts.join(wanted, "place").dropDuplicates(["place"]).select("node", "mark", "text")
        .mapInArrow(_sets(shingle_words), "node long, shingles array<long>")
    )
    links = tried = None
    rooted = members.withColumn("root", F.col("node"))
    for order in (F.lit(0).cast("long"), F.col("bucket")):
        # The first round prefers the same member in all buckets, the second another one in each.
        rank = F.xxhash64("node").bitwiseXOR(order)
        head = rooted.withColumn("rank", rank).groupBy("bucket").agg(F.min_by("node", "rank").alias("head"), F.min_by("root", "rank").alias("head_root"))
        pairs = rooted.join(head, "bucket").where("root <> head_root").select(*_ordered("node", "head")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = _verified(_sketched(pairs, nodes, percent), sets, percent)
        links = stored(found if links is None else links.unionByName(found))
        tried = pairs if tried is None else tried.unionByName(pairs)
        rooted = stored(_with_roots(members, links))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("bucket")
    spread = _in_tiles(rooted.join(mixed, "bucket", "left_semi").join(nodes.select("node", "n_shingles"), "node"))
    # The work is not in the bytes, so tasks must not be merged by their size.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = nodes.select("node", "n_shingles", "registers")
    dealt = spread.join(sketches, "node").repartition(tasks, *TILE).sortWithinPartitions(*TILE)
    kinds = "bucket long, low long, high long, band int, tile long, node long, root long"
    alike = stored(dealt.select(*TILE, "band", "tile", "node", "root", "n_shingles", "registers").mapInArrow(_alike(percent), kinds))
    full = alike.join(sketches, "node").join(sets, "node").repartition(tasks, *TILE).sortWithinPartitions(*TILE)
    rest = full.select(*TILE, "band", "tile", "node", "root", "n_shingles", "registers", "shingles").mapInArrow(_joining(percent), "a long, b long")
    return stored(links.unionByName(rest))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = SIMILARITY) -> DataFrame:
    """Every row's ``key``, ``place`` (128-bit hash of key and text), ``n_shingles``, ``component_id`` and ``kept``.

    Rows are linked if their shingle sets are at least ``percent`` similar;
    ``component_id`` is the smallest key a row reaches. ``kept`` marks one row
    of each component, the one with that key, or one of them. Rows without
    words are linked with nothing and all kept. Repeated rows and repeated keys
    are rows of their own, linked like any others. A row with a null key takes
    part; ``component_id`` is null where no row with a key is linked to it.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", place_of("key", "text"))
    kind = rows.schema["key"].dataType.simpleString()
    table = stored(
        rows.mapInArrow(_sketches(shingle_words), f"key {kind}, place binary, n_shingles long, mark string, registers binary")
        .withColumn("row", F.monotonically_increasing_id())
    )
    full = table.where("n_shingles > 0")
    # Rows with equal sets are one node: groups of copies, however large, go no further.
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    classes = stored(full.groupBy("mark").agg(F.min("row").alias("node"), first.alias("first")))
    nodes = stored(full.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi").select("node", "place", "mark", "n_shingles", "registers"))
    roots = components(_links(nodes, rows.select("place", "text"), shingle_words, percent))
    home = classes.join(roots, "node", "left").select("mark", "first", F.coalesce("root", "node").alias("root"))
    firsts = home.groupBy("root").agg(F.min("first").alias("head"))
    home = home.join(firsts, "root").select("mark", F.col("head.key").alias("component_id"), F.col("head.row").alias("head_row"))
    out = full.join(home, "mark").select("key", "place", "n_shingles", "component_id", (F.col("row") == F.col("head_row")).alias("kept"))
    empty = table.where("n_shingles = 0").select("key", "place", "n_shingles", F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(empty).withColumnRenamed("key", key)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest key; rows without words all stay."""
    stay = groups(docs.select(key, text), key, text, shingle_words, percent).where("kept").groupBy("place").agg((F.max("n_shingles") > 0).alias("_worded"))
    place = place_of(key, text)
    left = docs.withColumn("_place", place).join(stay.withColumnRenamed("place", "_place").hint("merge"), "_place")
    # Rows with the same key and text can't be told apart by their place.
    copy = F.when(F.col("_worded"), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id())
    return left.withColumn("_copy", copy).dropDuplicates(["_place", "_copy"]).select(*docs.columns)
