"""Text to numbered lines, and the filters that switch lines off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.functions.text import expand_whitespace, is_blank
from leakframe.options import ScanOptions


def split_lines(texts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(file_path, text) to (file_path, line_number, line); trailing empty lines stay.

    Lines count from 1, or from ``first_line`` where the texts are pieces and
    have it. Numbers stop at the largest integer. Columns of ``carry`` go along.
    """
    if "first_line" not in texts.columns:
        split = texts.select("file_path", *carry, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        return split.select("file_path", (F.col("pos") + 1).alias("line_number"), "line", *carry)
    split = texts.select("file_path", *carry, "first_line", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    number = F.least(F.col("first_line") + F.col("pos"), F.lit(2**31 - 1)).cast("int")
    return split.select("file_path", number.alias("line_number"), "line", *carry)


def has_directive(line: Column, directive: str) -> Column:
    return F.contains(line, F.lit(directive))


def matches_ignore_pattern(line: Column, pattern: str) -> Column:
    return F.rlike(line, F.lit("(?d)" + expand_whitespace(pattern)))


def scannable(line: Column, options: ScanOptions) -> Column:
    """False for blank lines, lines with the inline directive, and lines an ignore pattern hits."""
    kept = ~is_blank(line)
    if options.ignore_directive:
        kept = kept & ~has_directive(line, options.ignore_directive)
    for pattern in options.ignore_line_patterns:
        kept = kept & ~matches_ignore_pattern(line, pattern)
    return kept


def keep_scannable(lines: DataFrame, options: ScanOptions) -> DataFrame:
    """Drop the lines that are not to be scanned."""
    return lines.where(scannable(F.col("line"), options))
