"""Scan state: which content was scanned when, and with how many findings.

The functions are plain DataFrame operators on state rows. ``StateTable`` keeps
such rows in storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe.operators.findings import findings_per_file
from leakframe.operators.skew import filter_join
from leakframe.sources.shared import stored

STATE_SCHEMA = "file_path STRING, file_hash STRING, last_scanned TIMESTAMP, findings_count BIGINT"
STATE_COLUMNS = ("file_path", "file_hash", "last_scanned", "findings_count")


def changed(current: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of ``current(file_path, file_hash, ...)`` that are new or differ from the state."""
    known = state.select("file_path", "file_hash")
    return current.join(known, ["file_path", "file_hash"], "left_anti")


def has_changed(current: DataFrame, state: DataFrame) -> DataFrame:
    """(file_path, has_changed) for every current file."""
    known = state.select("file_path", F.col("file_hash").alias("stored"))
    return current.join(known, "file_path", "left").select(
        "file_path", (~F.col("file_hash").eqNullSafe(F.col("stored"))).alias("has_changed")
    )


def lookup(paths: DataFrame, state: DataFrame) -> DataFrame:
    """(file_path, file_hash), null where nothing is stored."""
    return paths.select("file_path").join(state.select("file_path", "file_hash"), "file_path", "left")


def stats(state: DataFrame) -> DataFrame:
    """(cached_files, total_findings), zeros for an empty state."""
    return state.agg(
        F.count(F.lit(1)).alias("cached_files"),
        F.coalesce(F.sum("findings_count"), F.lit(0)).alias("total_findings"),
    )


def state_rows(scanned: DataFrame, findings: DataFrame) -> DataFrame:
    """State rows of scanned (file_path, file_hash), with how many findings each has."""
    return findings_per_file(scanned, findings, keep=("file_hash",)).select(
        "file_path", "file_hash", F.current_timestamp().alias("last_scanned"), "findings_count"
    )


def carry_forward(previous: DataFrame, current: DataFrame, rescanned: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Findings of this pass plus the stored ones of files it did not scan again.

    With ``present(file_path)``, the files that are there now, findings of
    deleted files are dropped. What is to be dropped is told by paths alone and
    written, so that Spark knows its size: findings move only where that is large.
    """
    spread_by = ["line_number", "rule_id", "matched_value"]
    if present is None:
        return filter_join(previous, rescanned, ["file_path"], "left_anti", spread_by).unionByName(current)
    named = previous.where("file_path IS NOT NULL")
    staying = present.select("file_path").join(rescanned.select("file_path"), "file_path", "left_anti")
    dropped = stored(named.select("file_path").distinct().join(staying, "file_path", "left_anti"), "dropped")
    return filter_join(named, dropped, ["file_path"], "left_anti", spread_by).unionByName(current)


DETAILS = f"{STATE_SCHEMA}, modified TIMESTAMP, length BIGINT, rules STRING, batch STRING"
DETAIL_COLUMNS = (*STATE_COLUMNS, "modified", "length", "rules", "batch")
BUCKETS = 32


class StateTable:
    """State rows in storage: one Parquet table, partitioned by a hash of the path into ``buckets`` folders.

    A change rewrites the buckets it touches and no others, by dynamic partition
    overwrite, so the number of folders is fixed however many changes there
    were. Besides the columns of the state a row holds time and length of the
    file as it was listed, the rule set it was scanned with, and the ``batch``
    that wrote it. A path that is removed keeps a row without a hash, its
    tombstone. Where a write dies half-way, rows of a bucket may be missing;
    their files count as new then, so that nothing goes unscanned. One writer
    at a time; a table keeps the number of buckets it began with, about one for
    each million paths is right.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        empty = spark.createDataFrame([], f"{DETAILS}, bucket INT")
        empty.write.mode("ignore").partitionBy("bucket").parquet(self.path)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{DETAILS}, bucket INT").parquet(self.path)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        given = {f.name for f in rows.schema}
        blank = {"rules": F.lit(""), "batch": F.lit("")}
        kinds = dict(part.split(" ") for part in DETAILS.split(", "))
        columns = [(F.col(c) if c in given else blank.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in DETAIL_COLUMNS]
        return rows.select(*columns, F.pmod(F.xxhash64("file_path"), F.lit(self.buckets)).cast("int").alias("bucket"))

    def _replace(self, rows: DataFrame) -> None:
        """Put ``rows`` in the place of all rows of their paths."""
        rows = stored(rows, "state-change")
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        left = self._all().where(F.col("bucket").isin(touched)).join(rows.select("file_path"), "file_path", "left_anti")
        after = left.select(*DETAIL_COLUMNS, "bucket").unionByName(rows).repartition("bucket")
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def details(self, except_batch: str | None = None) -> DataFrame:
        """All live rows with their further columns; without those that ``except_batch`` wrote."""
        rows = self._all().where("file_hash IS NOT NULL").select(*DETAIL_COLUMNS)
        return rows if except_batch is None else rows.where(~F.col("batch").eqNullSafe(F.lit(except_batch)))

    def current(self, except_batch: str | None = None) -> DataFrame:
        """The state.

        A replayed batch asks for it without its own rows: whatever it changed
        then counts as changed again, and what it did not change is still there.
        """
        return self.details(except_batch).select(*STATE_COLUMNS)

    def put(self, rows: DataFrame, batch: str = "", gone: DataFrame | None = None) -> None:
        """Insert or replace by path, which is distinct in ``rows``; putting the same rows again changes nothing.

        ``batch`` names who wrote them, unless ``rows`` have that column.
        Paths of ``gone``, which are others, are removed in the same change.
        """
        change = self._bucketed(rows if "batch" in rows.columns else rows.withColumn("batch", F.lit(batch)))
        self._replace(change if gone is None else change.unionByName(self._tombstones(gone)))

    def remove(self, paths: DataFrame) -> None:
        """Leave a tombstone for each of the paths that the state knows."""
        self._replace(self._tombstones(paths))

    def _tombstones(self, paths: DataFrame) -> DataFrame:
        known = self.details().join(paths.select("file_path"), "file_path", "left_semi")
        return self._bucketed(known.select("file_path", F.lit(None).cast("string").alias("file_hash"), F.current_timestamp().alias("last_scanned")))

    def removed(self) -> DataFrame:
        """(file_path, since) of the tombstones."""
        return self._all().where("file_hash IS NULL").select("file_path", F.col("last_scanned").alias("since"))

    def clear(self) -> None:
        empty = self.spark.createDataFrame([], f"{DETAILS}, bucket INT")
        empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self.path)
