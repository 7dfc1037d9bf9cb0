"""Shards by jump consistent hashing (Lamping and Veach): no ring table, minimal moves when shards are appended.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

# Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64

_UNSIGNED = "decimal(20,0)"

STEPS = 32  # jumps tried before the rare rest; ln(shards) are expected
BUCKET_ROWS = 50_000  # rows numbered by one sort
CHUNK = 10_000  # repeated rows written out by one task at a time


def _whole(value: int) -> Column:
    return F.lit(str(value)).cast(_UNSIGNED)


def _jump(state: Column, shards: int) -> Column:
    """One jump of (key, bucket, next); a state whose next lies outside stays."""
    seed = ((state["key"] * _whole(MULTIPLIER) + _whole(1)) % _whole(WORD)).cast(_UNSIGNED)
    top = F.floor(seed / _whole(1 << 33)).cast("double")
    landed = F.floor((state["next"].cast("double") + 1.0) * (F.lit(float(1 << 31)) / (top + 1.0))).cast("long")
    moved = F.struct(seed.alias("key"), state["next"].alias("bucket"), landed.alias("next"))
    return F.when(state["next"] < shards, moved).otherwise(state)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a bigint key; null counts as 0. Exact for any number of shards."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0))
    unsigned = (key.cast(_UNSIGNED) + F.when(key < 0, _whole(WORD)).otherwise(_whole(0))).cast(_UNSIGNED)
    start = F.struct(unsigned.alias("key"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("next"))
    jump = lambda state, _: _jump(state, shards)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(STEPS, shards + 1))), start, jump)
    if shards > STEPS:  # every jump moves ahead by one at least
        state = F.when(state["next"] >= shards, state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, jump))
    return state["bucket"].cast("int")


def shard_key(docs: DataFrame, key: str) -> Column:
    """Integers are their own key; any other column is hashed. Null stays null."""
    if isinstance(docs.schema[key].dataType, IntegralType):
        return F.col(key).cast("long")
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))


def assign(docs: DataFrame, key: str, shards: int) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (the shard after one more is appended). No shuffle.

    The key and the number of shards decide alone: equal keys meet in a shard,
    and with one more shard a row stays or moves into the new one. A null key
    goes where key 0 goes. Columns of these two names are replaced.
    """
    k = shard_key(docs, key)
    return docs.withColumns({"shard": jump_hash(k, shards), "grown_shard": jump_hash(k, shards + 1)})


def number(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Rows with ``slot``: 0, 1, 2, ... within each shard, by content, the same for recomputed tasks.

    Equal rows are counted before they move, and shards are cut into buckets by
    a hash of the row, so neither a shard nor a repeated row meets in one task;
    rows repeated very often are written out again in chunks. Which of equal
    rows has which slot does not matter. An empty table gives no rows.
    """
    columns = rows.columns
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    distinct = rows.groupBy(*columns).agg(F.count("*").alias("_copies"))
    distinct = distinct.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    sizes = distinct.groupBy(shard, "_bucket").agg(F.sum("_copies").alias("_size"))
    # One row a bucket: a thousandth of a hundredth of the input's rows.
    first = sizes.withColumn("_first", F.sum("_size").over(Window.partitionBy(shard).orderBy("_bucket")) - F.col("_size")).drop("_size")
    bucket = Window.partitionBy(shard, "_bucket").orderBy(*columns)
    ahead = F.sum("_copies").over(bucket.rowsBetween(Window.unboundedPreceding, -1))
    placed = distinct.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).join(first, [shard, "_bucket"])
    placed = placed.withColumn("slot", F.col("_first") + F.col("_ahead")).select(*columns, "slot", "_copies")
    few = placed.where(F.col("_copies") <= CHUNK)
    many = (
        placed.where(F.col("_copies") > CHUNK)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(CHUNK).cast("long"))))
        .repartition(*columns, "_chunk")
        .select(*columns, (F.col("slot") + F.col("_chunk")).alias("slot"), F.least(F.lit(CHUNK).cast("long"), F.col("_copies") - F.col("_chunk")).alias("_copies"))
    )
    return few.unionByName(many).select(
        *columns, F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("_copies") - 1)).alias("slot")
    )


def write_shards(docs: DataFrame, key: str, shards: int, path: str, files: int = 1) -> None:
    """Write each shard as a folder ``shard=N`` of ``files`` files or so; a shard may be dealt to many tasks."""
    columns = [c for c in docs.columns if c not in ("shard", "grown_shard")]
    out = assign(docs, key, shards).drop("grown_shard").withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(files)))
    out.repartition(shards * files, "shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)
