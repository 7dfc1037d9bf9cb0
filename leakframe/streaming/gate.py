"""Streams: scan arriving rows, split them by verdict, skip content already seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from leakframe.functions.text import fingerprint
from leakframe.operators.bitmap import bitmap, with_possible
from leakframe.operators.findings import public_findings, summary
from leakframe.operators.skew import filter_join
from leakframe.operators.state import StateTable, changed, state_rows
from leakframe.options import ScanOptions
from leakframe.plans.scan import scan_changed, scan_texts
from leakframe.severity import SEVERITIES, severity_rank
from leakframe.sources.shared import stored
from leakframe.sources.tables import texts_of


def scan_stream(stream: DataFrame, key: str | Column, text: str | Column, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of a stream, as a stream. Detection is stateless, so no watermark is needed."""
    return scan_texts(texts_of(stream, key, text), options)


def gate_batch(rows: DataFrame, key: str, text: str, out: str, batch_id: int, options: ScanOptions) -> None:
    """Scan one batch and write its findings, summary, clean rows and quarantined rows.

    Every output goes to a directory named after the batch and is overwritten,
    so a replayed batch leaves the same result. A key with any finding at or
    above the block level is quarantined whole.
    """
    spark = rows.sparkSession
    part = f"batch={batch_id}"
    public_findings(scan_texts(texts_of(rows, key, text), options)).write.mode("overwrite").parquet(
        f"{out}/findings/{part}"
    )
    findings = spark.read.parquet(f"{out}/findings/{part}").withColumnRenamed("file", "file_path")
    summary(findings, options.block_level).write.mode("overwrite").json(f"{out}/summary/{part}", ignoreNullFields=False)

    rank, _ = SEVERITIES[options.block_level]
    # Rows without a key share the empty one, so that a leak among them is held back too.
    blocked = findings.where(severity_rank(F.col("severity")) >= rank).select(
        F.coalesce("file_path", F.lit("")).alias("_key")
    )
    blocked = stored(blocked.distinct(), "blocked")
    keyed = rows.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("")))
    # Nearly all texts are told clean where they are; only those whose key may be blocked meet the blocked keys.
    judged = with_possible(keyed, F.col("_key"), stored(bitmap(blocked, "_key"), "blocked-bits"), "_possible")
    possible = stored(judged.where("_possible"), "possible")
    spread_by = ["_key", text]
    held = filter_join(possible, blocked, ["_key"], "left_semi", spread_by)
    passed = filter_join(possible, blocked, ["_key"], "left_anti", spread_by)
    for side, part_of in (("quarantine", held), ("clean", judged.where("NOT _possible").unionByName(passed))):
        part_of.select(*rows.columns).write.mode("overwrite").parquet(f"{out}/{side}/{part}")


def stream_gate(
    stream: DataFrame, key: str, text: str, out: str, options: ScanOptions = ScanOptions()
) -> DataStreamWriter:
    """Writer that gates every batch of a stream; set trigger and checkpoint, then ``start()``."""
    return stream.writeStream.foreachBatch(
        lambda rows, batch_id: gate_batch(rows, key, text, out, batch_id, options)
    )


def skip_seen_batch(
    rows: DataFrame, key: str, text: str, out: str, batch_id: int, state: StateTable, name: str, options: ScanOptions
) -> None:
    """Scan the rows of a batch whose content the state does not hold, then record them."""
    spark = rows.sparkSession
    tag = f"{name}:{batch_id}"
    part = f"batch={batch_id}"
    hashed = texts_of(rows, key, text).withColumn("file_hash", fingerprint(F.col("text").cast("binary")))
    # A replay must see the state without what this batch wrote.
    # Only paths and hashes meet the state; the texts are taken by what that leaves.
    keys = hashed.select("file_path", "file_hash").distinct()
    changed(keys, state.current(except_batch=tag)).write.mode("overwrite").parquet(f"{out}/scanned/{part}")
    scanned = spark.read.parquet(f"{out}/scanned/{part}")
    named = stored(scanned.select(F.xxhash64("file_path", "file_hash").alias("_name")), "scanned")
    possible = with_possible(hashed.withColumn("_name", F.xxhash64("file_path", "file_hash")), F.col("_name"), stored(bitmap(named, "_name"), "scanned-bits"), "_possible")
    # Texts that are known already go no further; the others meet the keys that are new.
    fresh = possible.where("_possible").drop("_name", "_possible").join(scanned, ["file_path", "file_hash"], "left_semi")
    public_findings(scan_texts(fresh, options)).write.mode("overwrite").parquet(f"{out}/findings/{part}")
    findings = spark.read.parquet(f"{out}/findings/{part}").withColumnRenamed("file", "file_path")
    # One row per path: of several contents of one path the greatest hash is recorded.
    latest = scanned.groupBy("file_path").agg(F.max("file_hash").alias("file_hash"))
    state.put(state_rows(latest, findings), batch=tag)


def watch_files(spark: SparkSession, path: str, state: StateTable, out: str, options: ScanOptions = ScanOptions(), **asked) -> DataStreamWriter:
    """Writer that scans a tree at every trigger: all files, hidden and empty ones included, that are new, changed or back.

    Tasks list the folders, as for a batch, and meet the state there; the stream
    only keeps time, and ``trigger(availableNow=True)`` takes one turn. A turn
    that is repeated after a failure opens what the state does not hold yet.
    Each turn writes its findings below ``out``, see ``scan_changed``;
    ``current_findings`` are those of the content that is there now.
    """
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return clock.writeStream.foreachBatch(lambda tick, turn: scan_changed(spark, path, state, out, options, **asked) and None)


def stream_skip_seen(
    stream: DataFrame, key: str, text: str, out: str, state: StateTable, options: ScanOptions = ScanOptions(),
    name: str = "stream",
) -> DataStreamWriter:
    """Writer that scans only new or changed content of a stream."""
    return stream.writeStream.foreachBatch(
        lambda rows, batch_id: skip_seen_batch(rows, key, text, out, batch_id, state, name, options)
    )
