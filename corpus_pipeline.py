"""A corpus pipeline of five stages, each one operator of ``leakframe.llm`` applied to all documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and reads it back as the next one's documents.

Of every stage: rows with a null in any column stay rows like others, a null text
counts as an empty one, and a null key as a key after all others. Repeated rows
are rows of their own unless a stage removes copies. An empty table gives an empty
one. Columns of ``docs`` keep their values whatever their names; only ``text`` and
``n_chars`` change, and the last stage's ``ids`` and ``n_tokens`` take the place of
columns so named.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe.llm import decontamination, line_dedup, near, piece_bpe, toxicity
from leakframe.llm.queries import ORACLES as _ORACLES
from leakframe.llm.queries import PIECE_MODEL, table
from leakframe.llm.queries import QUERIES as _QUERIES
from leakframe.llm.scratch import ready, stored

WORD = "[^\\x20\\x09-\\x0D]"


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's result, its operator having seen no column of ``docs`` but its own three."""
    own = [c for c in docs.columns if c in ("doc_id", "text", "n_chars")]
    others = {c: f"_aside{i}" for i, c in enumerate(docs.columns) if c not in own}
    out = stage(docs.select(*own, *[F.col(f"`{c}`").alias(name) for c, name in others.items()]))
    back = [c for c in out.columns if c not in own and c not in others.values()]
    taken = {c.lower() for c in back}
    return out.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns if c.lower() not in taken], *back)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models don't call toxic; they are learnt from the labelled among these documents.

    Documents without words stay. Without labels all stay.
    """
    def stage(docs: DataFrame) -> DataFrame:
        scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
        return scored.where((F.col("predicted") == 0) | ~F.coalesce("text", F.lit("")).rlike(WORD)).drop("score", "predicted")

    return _apart(docs, stage)


def _rewritten(docs: DataFrame, columns: list[str], cut: Column) -> DataFrame:
    """``docs`` where ``cut`` says which texts were cut: those get a new ``n_chars``, and go if no word is left."""
    left = docs.where(~cut | F.col("text").rlike(WORD))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words and more that stood in an earlier one, or further up.

    Earlier is the smaller key; rows with the same key and text are one
    document. A document that has no word left goes.
    """
    return _apart(docs, lambda docs: _rewritten(line_dedup.dedup(docs), docs.columns, F.size("runs") > 0))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and a similarity of 0.8.

    That of the smallest key stays; documents without words all stay.
    """
    return _apart(docs, near.one_of_each)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with benchmark items; one that has no word left goes."""
    def stage(docs: DataFrame) -> DataFrame:
        found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
        return _rewritten(decontamination.without_spans(found), docs.columns, F.size("spans") > 0)

    return _apart(docs, stage)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ``ids`` and ``n_tokens``; ``text`` is what the ids decode to, empty for a null."""
    def stage(docs: DataFrame) -> DataFrame:
        coded = piece_bpe.encode_and_decode(docs, public_tokenizers.path(PIECE_MODEL))
        return coded.select(*docs.columns, "ids", F.size("ids").alias("n_tokens"))

    return _apart(docs, stage)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(ready(spark), docs, sf_dir))
    return docs


#: Models, sketches and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {**_QUERIES, "pipeline": run}
ORACLES = dict(_ORACLES)
