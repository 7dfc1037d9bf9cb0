"""Severity levels, their order and their actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe.functions.text import WHITESPACE

# Level -> (rank, action).
SEVERITIES: dict[str, tuple[int, str]] = {
    "LOW": (1, "Warning"),
    "MEDIUM": (2, "Warning + Confirmation"),
    "HIGH": (3, "Commit Block"),
    "CRITICAL": (4, "Force Block"),
}


def parse_severity(name: str) -> str:
    """Canonical level name; unknown names raise with the valid ones listed."""
    level = name.strip().upper()
    if level not in SEVERITIES:
        raise ValueError(f"unknown severity {name!r}; valid values: {list(SEVERITIES)}")
    return level


def _bare(severity: Column) -> Column:
    return F.upper(F.regexp_replace(severity, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", ""))


def severity_level(severity: Column) -> Column:
    """Column form of :func:`parse_severity`; an unknown name fails the query."""
    level = _bare(severity)
    return F.when(level.isin(*SEVERITIES), level).when(
        level.isNotNull(), F.raise_error(F.concat(F.lit("unknown severity: "), severity)).cast("string")
    )


def _per_level(severity: Column, position: int) -> Column:
    out = None
    for level, values in SEVERITIES.items():
        hit = _bare(severity) == level
        out = F.when(hit, F.lit(values[position])) if out is None else out.when(hit, F.lit(values[position]))
    return out


def severity_rank(severity: Column) -> Column:
    return _per_level(severity, 0)


def severity_action(severity: Column) -> Column:
    return _per_level(severity, 1)


def severity_dimension(spark: SparkSession) -> DataFrame:
    rows = [(level, rank, action) for level, (rank, action) in SEVERITIES.items()]
    return spark.createDataFrame(rows, "severity STRING, rank INT, action STRING")
