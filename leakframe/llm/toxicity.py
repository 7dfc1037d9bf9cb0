"""Toxicity scores from class-conditional Kneser-Ney models.

Two character models, of toxic and of ordinary texts, share every lower order:
only n-grams of the full length are counted by class, anything rarer backs off
to pooled continuation counts, so an expression neither class knows adds nothing
to either side. A text's evidence is the difference of the two log-likelihoods,
per character and in its worst passages of several lengths. A logistic curve
fitted on labelled rows the models have not seen turns it into a probability.

Counts cover all labelled training rows and grow with them. So do the two tables
of exact ratios made of them: they are stored, sorted, in the shared folder, and
the driver never holds them. Workers keep small tables in memory and read large
ones in order past the n-grams they ask for; nothing is copied to local disks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leakframe.llm.scratch import shared_folder, stored
from leakframe.llm.tokens import ALNUM, buffers, pieces

ORDER = 5  # bytes of an n-gram
LOWER = (4, 2, 1)  # shared orders
SHARED_DISCOUNT = 0.75  # also of class counts where their counts of counts say nothing
WINDOWS = (16, 64, 256)  # bytes of the passages looked at
FOLDS = 5
HELD_OUT, CALIBRATION = 0, 4
CALIBRATION_ROWS = 20_000  # bound of the sample the logistic curve is fitted on
TABLES_HELD = 4  # tables of ratios a worker keeps in memory: those of two models
HELD_ROWS = 8_000_000  # rows of ratios (12 bytes each) they may have together; larger ones are read past each slice of texts

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[0x41:0x5B] += 0x20
_LETTERS[~ALNUM] = 0x20


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts with the bytes before it, packed, and the bounds of the texts.

    A-Z are lower-cased, anything but letters and digits is a space, runs of
    spaces are one, and a text is preceded by spaces.
    """
    data, bounds = buffers(texts)
    data = _LETTERS[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    kept = np.ones(len(data), bool)
    kept[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    kept |= first[:-1]
    bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
    data = data[kept]
    at = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    keys = data.astype(np.int64)
    for back in range(1, ORDER):
        before = np.full(len(data), 0x20, np.int64)
        before[back:] = data[:-back]
        before[at < back] = 0x20
        keys |= before << (8 * back)
    return keys, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text", 2 << 20):
        keys, bounds = _grams(piece.column("text"))
        toxic = np.repeat(piece.column("toxic").to_numpy() == 1, np.diff(bounds))
        found, which = np.unique(keys, return_inverse=True)
        bad = np.bincount(which, toxic, len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(bad), pa.array(np.bincount(which, minlength=len(found)) - bad)], ["gram", "bad", "fine"]
        )


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, bad, fine): exact counts of all n-grams in rows (text, toxic)."""
    each = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_count, "gram long, bad long, fine long")
    return each.groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))


def _last(key: str, size: int) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << (8 * size)) - 1))


def _shared(counts: DataFrame) -> DataFrame:
    """(gram of ``LOWER[0]`` bytes, shared): interpolated probabilities of pooled continuation counts."""
    levels, longer = [], counts.select("gram")
    for size in LOWER:
        longer = longer.groupBy(_last("gram", size).alias("gram")).agg(F.count("*").cast("double").alias("kinds"))
        levels.append((size, longer))
    below = None
    for size, level in reversed(levels):
        level = level.withColumn("context", F.shiftright("gram", 8))
        total = level.groupBy("context").agg(F.sum("kinds").alias("total"), F.count("*").alias("types"))
        level = level.join(total, "context")
        if below is None:
            level = level.withColumn("lower", F.lit(1 / 256))
        else:
            level = level.withColumn("short", _last("gram", below[0])).join(below[1].select(F.col("gram").alias("short"), F.col("shared").alias("lower")), "short")
        own = F.greatest(F.col("kinds") - SHARED_DISCOUNT, F.lit(0.0))
        below = (size, level.select("gram", ((own + SHARED_DISCOUNT * F.col("types") * F.col("lower")) / F.col("total")).alias("shared")))
    return below[1]


@dataclass(frozen=True)
class Ratios:
    """Log-likelihood ratios by packed key, as Parquet files in a shared folder, sorted over all files."""

    folder: str

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The ratio of each key, NaN for keys the table doesn't have."""
        if not len(keys):
            return np.empty(0)
        asked, which = np.unique(keys, return_inverse=True)
        out = np.full(len(asked), np.nan)
        for known, ratio in _parts(self.folder):
            low, high = np.searchsorted(asked, known[0]), np.searchsorted(asked, known[-1], "right")
            at = np.minimum(np.searchsorted(known, asked[low:high]), len(known) - 1)
            out[low:high] = np.where(known[at] == asked[low:high], ratio[at], out[low:high])
        return out[which]

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        """(key, ratio) of all rows, to look at small tables."""
        found = [np.stack([np.asarray(column, float) for column in part], 1) for part in _parts(self.folder)]
        return np.concatenate([*found, np.empty((0, 2))]).astype(dtype or float)


_held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}


def _parts(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and ratios of a stored table in parts, ascending; kept for the next call while there is room."""
    if folder in _held:
        yield from _held[folder]
        return
    found, inside = pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder) if re.match("[a-z0-9]+:", folder) else f"file://{folder}")
    files = sorted(f.path for f in found.get_file_info(pa.fs.FileSelector(inside)) if f.base_name.startswith("part-"))
    size = lambda: sum(len(part[0]) for parts in _held.values() for part in parts)
    while len(_held) >= TABLES_HELD or size() > HELD_ROWS // 2:
        del _held[next(iter(_held))]
    held, rows = [], size()
    for path in files:
        with found.open_input_file(path) as source:
            for batch in pa.parquet.ParquetFile(source).iter_batches(1 << 20, columns=["key", "ratio"]):
                if batch.num_rows:
                    part = batch.column("key").to_numpy(), batch.column("ratio").to_numpy()
                    rows += batch.num_rows
                    if held is not None and rows <= HELD_ROWS:
                        held.append(part)
                    else:
                        held = None
                    yield part
    if held is not None:
        _held[folder] = held


def _kept(rows: DataFrame) -> Ratios:
    """Rows (key, ratio) of different keys, stored in the order of the keys."""
    spark = rows.sparkSession
    folder = shared_folder(spark)
    rows = rows.select("key", F.col("ratio").cast("float").alias("ratio"))
    rows.repartitionByRange(spark.sparkContext.defaultParallelism, "key").sortWithinPartitions("key").write.parquet(folder)
    return Ratios(folder)


@dataclass
class Model:
    """Log-likelihood ratios of seen n-grams and of contexts whose n-gram is unseen, and the curve."""

    grams: Ratios
    contexts: Ratios
    curve: np.ndarray


def _discounts(counts: DataFrame) -> dict[str, list[float]]:
    """Of each class, what is taken off counts of 1, 2, and 3 or more: modified Kneser-Ney, from the counts of counts.

    Always more than nothing and less than the count, so that what a class has
    seen once adds to its evidence.
    """
    row = counts.agg(*[F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in ("bad", "fine") for k in (1, 2, 3, 4)]).first()
    out = {}
    for c in ("bad", "fine"):
        n = [row[f"{c}_{k}"] for k in (1, 2, 3, 4)]
        plain = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
        found = [k - (k + 1) * plain * n[k] / n[k - 1] if plain and n[k - 1] and n[k] else SHARED_DISCOUNT for k in (1, 2, 3)]
        out[c] = [min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), found, strict=True)]
    return out


def ratios(counts: DataFrame) -> tuple[Ratios, Ratios]:
    """The tables of all n-grams and of all contexts that were counted."""
    classes = ("bad", "fine")
    level = lambda c, k: (F.col(c) >= 3) if k == 3 else (F.col(c) == k)
    of = _discounts(counts)
    cut = lambda c: F.when(level(c, 3), of[c][2]).when(level(c, 2), of[c][1]).when(level(c, 1), of[c][0]).otherwise(0.0)
    counts = counts.withColumn("context", F.shiftright("gram", 8))
    contexts = counts.groupBy("context").agg(
        *[F.sum(c).cast("double").alias(f"{c}_all") for c in classes], *[F.count_if(level(c, k)).alias(f"{c}_{k}") for c in classes for k in (1, 2, 3)]
    )
    spare = lambda c: F.when(F.col(f"{c}_all") > 0, sum(of[c][k - 1] * F.col(f"{c}_{k}") for k in (1, 2, 3)) / F.col(f"{c}_all")).otherwise(1.0)
    contexts = contexts.select("context", "bad_all", "fine_all", spare("bad").alias("bad_spare"), spare("fine").alias("fine_spare"))
    shared = _shared(counts).select(F.col("gram").alias("short"), "shared")
    likelihood = lambda c: F.coalesce((F.col(c) - cut(c)) / F.nullif(F.col(f"{c}_all"), F.lit(0.0)), F.lit(0.0)) + F.col(f"{c}_spare") * F.col("shared")
    seen = counts.join(contexts, "context").withColumn("short", _last("gram", LOWER[0])).join(shared, "short")
    seen = seen.select(F.col("gram").alias("key"), F.log(likelihood("bad") / likelihood("fine")).alias("ratio"))
    unseen = contexts.select(F.col("context").alias("key"), F.log(F.col("bad_spare") / F.col("fine_spare")).alias("ratio"))
    return _kept(seen), _kept(unseen)


def evidence(texts: pa.Array, grams: Ratios, contexts: Ratios) -> np.ndarray:
    """A row for each text: 1 (0 for a text without letters), ratio per byte, per root of bytes, the most in a window of each size."""
    keys, bounds = _grams(texts)
    ratio = grams.find(keys)
    rare = np.flatnonzero(np.isnan(ratio))
    ratio[rare] = np.nan_to_num(contexts.find(keys[rare] >> 8))
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    start, size = bounds[:-1], np.diff(bounds)
    whole = total[bounds[1:]] - total[start]
    columns = [(size > 0).astype(float), whole / np.maximum(size, 1), whole / np.sqrt(size + 1)]
    for window in WINDOWS:
        most = whole.copy()
        longer = np.flatnonzero(size > window)
        if len(longer):
            sums = total[window:] - total[:-window]
            # Windows that begin in a text and end in it lie in [start, end - window].
            edges = np.stack([start[longer], bounds[1:][longer] - window + 1], 1).ravel()
            most[longer] = np.maximum.reduceat(np.append(sums, -np.inf), edges)[::2]
        columns.append(most)
    return np.stack(columns, 1)


def chance(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Scores of rows of evidence; without letters, a text has the share of toxic ones."""
    return 1 / (1 + np.exp(-np.clip(np.where(x[:, 0] > 0, x @ curve[:-1], curve[-1]), -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic curve, by Newton's method on scaled columns, and the log odds of all rows.

    Without both classes these odds are all there is.
    """
    curve = np.zeros(len(WINDOWS) + 3)
    odds = np.log((np.sum(y == 1) + 0.5) / (np.sum(y == 0) + 0.5))
    curve[0] = odds
    if len(set(y.tolist())) < 2:
        return np.append(curve, odds)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    mean[0], spread[0] = 0.0, 1.0
    z = (x - mean) / spread
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        slope = (z * (p * (1 - p))[:, None]).T @ z + penalty
        curve = curve - np.clip(np.linalg.solve(slope, z.T @ (p - y) + penalty @ curve), -5, 5)
    curve = curve / spread
    curve[0] -= mean[1:] @ curve[1:]
    return np.append(curve, odds)


def fold(key: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Models from labelled rows outside the held-out fold.

    The curve is fitted on a bounded sample of one fold, against models of all
    other rows; then that sample is counted too, so the models returned cover
    every row. Labels other than 0 and 1, null
    keys and labels of unknown texts are passed over; of several labels of a key
    the largest holds. Without labels every text scores alike.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("toxic"))
    known = known.withColumn("_fold", fold("_key"))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"), fold(key).alias("_fold"))
    sample = known.where(F.col("_fold") == CALIBRATION)
    share = CALIBRATION_ROWS / max(1, sample.count())
    drawn = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(min(1.0, 0.95 * share) * (1 << 30))
    chosen = (F.col("_fold") == CALIBRATION) & drawn
    counted = (F.col("_fold") != HELD_OUT) & ~chosen

    # Always dealt by key, so that the plan, and with it the shuffle, is the same for few labels and for many.
    def labelled(part: Column) -> DataFrame:
        return rows.where(part).join(known.where(part).hint("merge"), ["_key", "_fold"]).select("text", "toxic")

    counts = stored(count_grams(labelled(counted)))
    held_back = stored(labelled(chosen))
    grams, contexts = ratios(counts)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            x = evidence(piece.column("text"), grams, contexts)
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    found: pd.DataFrame = held_back.mapInArrow(weigh, "toxic int, x array<double>").orderBy("toxic", "x").toPandas()
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, len(WINDOWS) + 3))
    curve = fit_curve(x, found["toxic"].to_numpy())
    every = counts.unionByName(count_grams(held_back)).groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    return Model(*ratios(stored(every)), curve)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score of a half or more), row by row, no shuffle.

    Null and empty texts, and others without letters, score the share of toxic texts. Columns of these names are replaced.
    """
    docs = docs.select([c for c in docs.columns if c not in ("score", "predicted")])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            p = chance(evidence(piece.column(text), model.grams, model.contexts), model.curve)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*piece.schema.names, "score", "predicted"])

    schema = StructType(list(docs.schema.fields)).add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(apply, schema)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``."""
    scored = score(docs.select(key, F.col(text).cast("string").alias("text")), learn(docs, labels, key, text))
    return scored.select(key, (fold(key) == HELD_OUT).alias("held_out"), "score", "predicted")
