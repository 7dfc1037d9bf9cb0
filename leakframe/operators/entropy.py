"""Entropy analysis: candidate strings of a line, their class, score and finding fields."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.functions.text import (
    distinct_chars,
    expand_whitespace,
    is_hex,
    mask_entropy_value,
    shannon_entropy,
    spell_out_ranges,
    string_type,
)
from leakframe.operators.gate import CANDIDATE_CLASS, entropy_gate, fewest_different, shortest_entropy_hit
from leakframe.options import ScanOptions

# The rule id and type of entropy findings.
ENTROPY_RULE_ID = "entropy-detection"
ENTROPY_TYPE = "High Entropy String"

# The three candidate patterns.
QUOTED = r"""(?:["'])([A-Za-z0-9+/=_\-]{12,})(?:["'])"""
ASSIGNED = r"""(?:=|:)\s*["']?([A-Za-z0-9+/=_\-]{12,})["']?"""
STANDALONE = r"""\b([A-Za-z0-9+/=_\-]{20,})\b"""

# A word boundary over Unicode letters, digits and underscore; what Java's \b
# means differs between JDK releases.
_WORD = r"[A-Za-z0-9_\p{L}\p{N}]"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
# Asked first: looking for 20 characters is cheaper than looking for a boundary.
_LONG_ENOUGH = rf"(?=[{CANDIDATE_CLASS}]{{20}})"


def _all_matches(line: Column, pattern: str, needed: str = "") -> Column:
    """All values of a pattern; it is tried only on lines that have one of the characters ``needed``."""
    java = "(?d)" + spell_out_ranges(expand_whitespace(pattern.replace(r"\b", _BOUNDARY)))
    found = F.regexp_extract_all(line, F.lit(java), F.lit(1))
    if not needed:
        return found
    some = reduce(or_, [F.contains(line, F.lit(c)) for c in needed])
    return F.when(~some, F.array().cast("array<string>")).otherwise(found)


def quoted_candidates(line: Column) -> Column:
    return _all_matches(line, QUOTED, "\"'")


def assigned_candidates(line: Column) -> Column:
    return _all_matches(line, ASSIGNED, "=:")


def standalone_candidates(line: Column) -> Column:
    return _all_matches(line, _LONG_ENOUGH + STANDALONE)


def candidate_set(line: Column, options: ScanOptions) -> Column:
    """Distinct candidates of a line within the length bounds."""
    found = F.array_distinct(
        F.concat(quoted_candidates(line), assigned_candidates(line), standalone_candidates(line))
    )
    return F.filter(found, lambda v: F.length(v).between(options.min_length, options.max_length))


def threshold(value: Column, options: ScanOptions) -> Column:
    return F.when(is_hex(value), F.lit(options.hex_entropy_threshold)).otherwise(F.lit(options.entropy_threshold))


def scored_hits(candidates: Column, options: ScanOptions) -> Column:
    """Array of (raw_value, entropy) for the candidates that reach their threshold.

    Candidates too short to reach it are dropped, and those with too few
    different characters are not scored. What is asked of a candidate twice, its
    class and its characters, is worked out once. Candidates are ASCII.
    """
    plain, hexa = shortest_entropy_hit(options)
    classed = F.transform(candidates, lambda v: F.struct(v.alias("raw_value"), is_hex(v).alias("hex")))
    by_class = lambda c, others, hexes: F.when(c["hex"], F.lit(hexes)).otherwise(F.lit(others))
    long_enough = F.filter(classed, lambda c: F.length(c["raw_value"]) >= by_class(c, plain, hexa))
    spelt = F.transform(long_enough, lambda c: F.struct(c["raw_value"], c["hex"], distinct_chars(c["raw_value"]).alias("chars")))
    mixed = lambda c: F.size(c["chars"]) >= by_class(c, *fewest_different(options))
    bits = lambda c: F.when(mixed(c), shannon_entropy(c["raw_value"], c["chars"], ascii_only=True))
    scored = F.transform(spelt, lambda c: F.struct(c["raw_value"], bits(c).alias("entropy"), c["hex"]))
    return F.filter(scored, lambda h: h["entropy"] >= by_class(h, options.entropy_threshold, options.hex_entropy_threshold))


def entropy_severity(entropy: Column, length: Column, kind: Column) -> Column:
    """Level from entropy, with a bonus for long values and for hex or base64."""
    # The steps of the score and the levels.
    score = (
        entropy
        + F.when(length > 40, 0.5).when(length > 30, 0.3).otherwise(0.0)
        + F.when(kind.isin("hex", "base64"), 0.2).otherwise(0.0)
    )
    return F.when(score >= 5.5, "CRITICAL").when(score >= 5.0, "HIGH").when(score >= 4.5, "MEDIUM").otherwise("LOW")


def entropy_description(entropy: Column, value: Column, options: ScanOptions, kind: Column | None = None) -> Column:
    kind = string_type(value) if kind is None else kind
    # Fixed value: the wording. bround first: %.2f alone would round exact ties up.
    least = F.when(kind == "hex", F.lit(options.hex_entropy_threshold)).otherwise(F.lit(options.entropy_threshold))
    return F.format_string(
        "High entropy %s string detected (entropy: %.2f, threshold: %.2f)", kind, F.bround(entropy, 2), least,
    )


def entropy_hits(lines: DataFrame, options: ScanOptions) -> DataFrame:
    """One row per high-entropy string of each line (lines as from ``split_lines``)."""
    hits = lines.where(entropy_gate(F.col("line"), options)).select(
        "file_path", F.col("line_number").alias("line"),
        F.explode(scored_hits(candidate_set(F.col("line"), options), options)).alias("hit"),
    )
    value, bits, kind = F.col("hit.raw_value"), F.col("hit.entropy"), F.col("kind")
    # A column of its own: several others are made from it.
    return hits.withColumn("kind", string_type(value)).select(
        "file_path",
        F.lit(ENTROPY_TYPE).alias("type"),
        mask_entropy_value(value).alias("value"),
        value.alias("raw_value"),
        "line",
        F.bround(bits, 4).alias("entropy"),
        kind.alias("string_type"),
        entropy_severity(bits, F.length(value), kind).alias("severity"),
        entropy_description(bits, value, options, kind).alias("description"),
    )
