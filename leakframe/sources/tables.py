"""Text columns of tables as scan input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def texts_of(table: DataFrame, key: str | Column, text: str | Column) -> DataFrame:
    """(file_path, text) from any table; the key is the label findings carry."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.col(text) if isinstance(text, str) else text
    return table.select(key.cast("string").alias("file_path"), text.alias("text"))


def spread(table: DataFrame) -> DataFrame:
    """Deal rows round-robin over the cores when a scan yields fewer tasks than cores.

    Patterns are CPU-bound, so a table of a few large row groups would leave
    most cores idle. An input with at least one split per core, which is any
    large one, passes through without a shuffle. Dealing ignores keys, so a hot
    key or a group of copies does not pile up in one task.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(2 * cores)


def read_texts(spark: SparkSession, path: str, key: str | Column, text: str | Column) -> DataFrame:
    """(file_path, text) from a Parquet table; only the two columns are read."""
    return spread(texts_of(spark.read.parquet(path), key, text))
