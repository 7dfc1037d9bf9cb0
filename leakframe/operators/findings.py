"""Roll-ups, filters, verdicts and text forms of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.severity import SEVERITIES, parse_severity, severity_action, severity_level, severity_rank
from leakframe.sources.shared import stored


def _level_count(level: str):
    return F.count_if(F.upper("severity") == level)


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, findings): always four rows, zeros included.

    One aggregation to one row, then unfolded; no join against the levels.
    """
    counted = findings.agg(*[_level_count(s).alias(s) for s in SEVERITIES])
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("findings")) for s in SEVERITIES])
    return counted.select(F.inline(rows))


def total_findings(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("total"))


def max_severity(findings: DataFrame) -> DataFrame:
    """(max_severity): null when there is no finding."""
    level = severity_level(F.col("severity"))
    return findings.agg(F.max_by(level, severity_rank(F.col("severity"))).alias("max_severity"))


def verdict(findings: DataFrame, block_level: str = "HIGH") -> DataFrame:
    """(should_block): whether any finding reaches the level; false when there is none."""
    return findings.agg(_blocks(block_level).alias("should_block"))


def _blocks(block_level: str):
    rank, _ = SEVERITIES[parse_severity(block_level)]
    reached = severity_rank(severity_level(F.col("severity"))) >= rank
    return F.coalesce(F.bool_or(reached), F.lit(False))


def should_block(findings: DataFrame, block_level: str = "HIGH") -> bool:
    return verdict(findings, block_level).first().should_block


def files_affected(findings: DataFrame) -> DataFrame:
    """The distinct files with findings, as rows: the list grows with the data."""
    return findings.select("file_path").distinct()


def summary_columns(block_level: str = "HIGH") -> list[Column]:
    """The aggregates of :func:`summary`."""
    level = severity_level(F.col("severity"))
    by_severity = F.create_map(*[c for s in reversed(SEVERITIES) for c in (F.lit(s), _level_count(s))])
    return [
        F.count(F.lit(1)).alias("total"),
        by_severity.alias("by_severity"),
        _blocks(block_level).alias("should_block"),
        F.max_by(level, severity_rank(F.col("severity"))).alias("max_severity"),
        F.count_distinct("file_path").alias("files_affected"),
    ]


def summary(findings: DataFrame, block_level: str = "HIGH") -> DataFrame:
    """One row: total, by_severity, should_block, max_severity, files_affected (a count).

    The files themselves are ``files_affected(findings)``.
    """
    return findings.agg(*summary_columns(block_level))


def counts_per_file(findings: DataFrame) -> DataFrame:
    """(file_path, severity, findings): how many findings of each level every affected file has."""
    return findings.groupBy("file_path", "severity").agg(F.count(F.lit(1)).alias("findings"))


def summary_of_counts(counts: DataFrame, block_level: str = "HIGH") -> DataFrame:
    """The row of :func:`summary`, from :func:`counts_per_file`: levels are looked at once for each file, not for each finding."""
    level, none = severity_level(F.col("severity")), F.lit(0).cast("long")
    of_level = lambda s: F.coalesce(F.sum(F.when(F.upper("severity") == s, F.col("findings"))), none)
    return counts.agg(
        F.coalesce(F.sum("findings"), none).alias("total"),
        F.create_map(*[c for s in reversed(SEVERITIES) for c in (F.lit(s), of_level(s))]).alias("by_severity"),
        _blocks(block_level).alias("should_block"),
        F.max_by(level, severity_rank(F.col("severity"))).alias("max_severity"),
        F.count_distinct("file_path").alias("files_affected"),
    )


def with_severity(findings: DataFrame, level: str) -> DataFrame:
    """Findings of one level, compared without case."""
    return findings.where(F.upper("severity") == level.upper())


def in_file(findings: DataFrame, file_path: str) -> DataFrame:
    return findings.where(F.col("file_path") == file_path)


def findings_per_file(scanned: DataFrame, findings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_path, findings_count) for every scanned file, zeros included.

    ``keep`` names more columns of ``scanned`` to carry along. Findings are
    counted before the join, so a file with very many of them crosses the
    shuffle as one partial count per task.
    """
    counts = findings.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return (
        scanned.select("file_path", *keep).distinct()
        .join(counts, "file_path", "left")
        .select("file_path", *keep, F.coalesce("n", F.lit(0)).alias("findings_count"))
    )


def with_action(findings: DataFrame) -> DataFrame:
    """Adds ``severity_rank`` and ``action``."""
    return findings.withColumns(
        {"severity_rank": severity_rank(F.col("severity")), "action": severity_action(F.col("severity"))}
    )


def public_findings(findings: DataFrame) -> DataFrame:
    """The form that may leave the engine: no raw value."""
    return findings.select(
        F.col("file_path").alias("file"), F.col("line_number").alias("line"),
        "rule_id", "description", "severity", "matched_value", "detection_method",
    )


def alert_lines(findings: DataFrame) -> DataFrame:
    """(alert, gate_line): one sentence and one compact line per finding."""
    return findings.select(
        F.format_string(
            "Possible %s or sensitive data detected at line %d of file %s", "rule_id", "line_number", "file_path"
        ).alias("alert"),
        F.format_string("[%s] %s:%d - %s: %s", "severity", "file_path", "line_number", "rule_id", "matched_value")
        .alias("gate_line"),
    )


def in_order(findings: DataFrame) -> DataFrame:
    """By file, line, and position on the line (catalog order, then entropy).

    The findings are written first: Spark looks at rows to be sorted twice, once
    to find the bounds of its ranges, and would scan twice for it.
    """
    return stored(findings, "unordered").orderBy("file_path", "line_number", "match_order")
