"""Tables written to the folder all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; only where that is unset, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", "") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return f"{base.rstrip('/')}/llm/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place_of(key: str, text: str) -> Column:
    """128 bits that rows share if they have the same key and text; a null key is a key, a null text is the empty one."""
    named = F.when(F.col(key).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(key).cast("string")))
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(named).cast("string"), named, text).cast("binary")))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package, wherever it was started; clusters get it by --py-files."""
    if spark.sparkContext.master.startswith(("local[", "local*")) or spark.sparkContext.master == "local":
        spark.sparkContext.addFile(str(Path(__file__).resolve().parents[1]), recursive=True)
    return spark
