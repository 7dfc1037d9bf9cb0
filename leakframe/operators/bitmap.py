"""A set of keys as a bitmap of fixed size: rows that can't be in it are told apart where they are.

Keys are hashed to one of 2**26 bits. The bits are 2,048 rows of four kilobytes
at most, whatever the number of keys, so they may be sent to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def _bit(key: Column) -> Column:
    # Buckets and positions count from a bitmap's first bit, which stands for 1.
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, bits) of all keys."""
    bit = _bit(F.col(key))
    marked = keys.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at"))
    return marked.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def with_possible(rows: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean: false where the key is certainly not in the set. No row moves."""
    bit = _bit(key)
    told = rows.withColumns({"_bucket": F.bitmap_bucket_number(bit), "_at": F.bitmap_bit_position(bit)})
    joined = told.join(F.broadcast(bits.withColumnRenamed("bucket", "_bucket")), "_bucket", "left")
    at = F.col("_at").cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.expr("shiftright(_byte, _at & 7) & 1") == 1, F.lit(False))
    return joined.withColumn("_byte", byte).withColumn("_at", at).withColumn(name, found).select(*rows.columns, name)
