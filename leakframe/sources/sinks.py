"""Sinks: findings table and report. Raw values never reach them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.operators.findings import counts_per_file, files_affected, public_findings, summary_of_counts
from leakframe.sources.shared import stored

REPORT_TOOL = "leakframe"
REPORT_VERSION = "1.0.0"


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Public findings, partitioned by severity."""
    public_findings(findings).write.mode(mode).partitionBy("severity").format(fmt).save(path)


def write_report(findings: DataFrame, path: str, block_level: str = "HIGH") -> None:
    """Write a report directory, also when nothing was found.

    ``findings/``        JSON lines, every finding
    ``files_affected/``  JSON lines, every file with findings
    ``summary/``         one JSON object

    The scan runs once, and the findings just written are read once: they are
    counted by file and level, and the roll-ups read these counts.
    """
    spark = findings.sparkSession
    table = f"{path}/findings"
    public = public_findings(findings)
    public.write.mode("overwrite").json(table)
    written = spark.read.schema(public.schema).json(table).withColumnRenamed("file", "file_path")
    counts = stored(counts_per_file(written), "counts")

    files = f"{path}/files_affected"
    files_affected(counts).withColumnRenamed("file_path", "file").write.mode("overwrite").json(files)

    taken = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp")
    frame = [F.lit(REPORT_TOOL).alias("tool"), F.lit(REPORT_VERSION).alias("version"), taken]
    parts = ("total", "by_severity", "should_block", "max_severity", "files_affected")
    head = summary_of_counts(counts, block_level).select(*frame, F.struct(*parts).alias("summary"))
    head.write.mode("overwrite").json(f"{path}/summary", ignoreNullFields=False)
