"""Allowlist held in a table, for lists too long for the options object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.operators.skew import filter_join


def drop_allowlisted(findings: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Findings whose value is not in ``allowlist(value)``, compared in lower case.

    One leaked value may make up a large part of all findings, hence the
    spread over lines.
    """
    listed = allowlist.select(F.lower("value").alias("_value")).where(F.col("_value").isNotNull())
    keyed = findings.withColumn("_value", F.lower("raw_value"))
    return filter_join(keyed, listed, ["_value"], "left_anti", ["file_path", "line_number"]).drop("_value")
