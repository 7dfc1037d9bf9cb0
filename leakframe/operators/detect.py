"""Detection: rules and entropy over lines, as one row-local expression and one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.functions.text import mask_entropy_value, mask_rule_value, spell_out_ranges, string_type
from leakframe.operators.entropy import (
    ENTROPY_RULE_ID,
    candidate_set,
    entropy_description,
    entropy_severity,
    scored_hits,
)
from leakframe.operators.gate import GUARDED_SHAPES, entropy_gate, first_letters, line_gate, shape_test, shortest_keywords
from leakframe.operators.lines import scannable
from leakframe.options import ScanOptions
from leakframe.rules import Rule

FINDING_COLUMNS = (
    "file_path", "line_number", "rule_id", "description", "severity",
    "matched_value", "raw_value", "detection_method",
)
_HITS = "array<struct<ordinal:int,raw_value:string,entropy:double>>"


def _sql(text: str) -> str:
    """A SQL string literal; ``${`` is spelt so that no variable is substituted."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{") + "'"


def has_keyword(lower_line: str, rule: Rule) -> str:
    """SQL test that a lower-cased line column holds a keyword of the rule."""
    return " OR ".join(f"contains({lower_line}, {_sql(k)})" for k in shortest_keywords(rule.keywords)) or "true"


# What the keywords of several rules have in common. A line is searched for it once; only where it is found, for those keywords.
SHARED_PARTS = {"part_line": "_", "part_dot": ".", "part_gh": "gh"}


def _worth_trying(lower_line: str, rule: Rule) -> str:
    shapes = [f"has_{rule.shape}"] if rule.shape in GUARDED_SHAPES else []
    parts = [name for name, part in SHARED_PARTS.items() if rule.keywords and all(part in k for k in rule.keywords)]
    return " AND ".join([*shapes, *parts, f"({has_keyword(lower_line, rule)})"])


def rule_values(line: str, rule: Rule) -> str:
    """SQL array of all values the rule's pattern finds in a line column, left to right."""
    return f"regexp_extract_all({line}, {_sql(quick_pattern(rule))}, {rule.group_idx})"


def quick_pattern(rule: Rule) -> str:
    """The rule's pattern in a form that finds the same and that Java goes through faster.

    Of built-in rules (those with a shape) ranges are spelt out, and where case
    does not count a look at one character comes before the key names are tried.
    """
    if rule.shape is None:
        return rule.java_pattern
    if not rule.ignore_case:
        return spell_out_ranges(rule.java_pattern)
    heads = first_letters(rule.pattern)
    return rule.java_pattern.replace("(?diu)", f"(?diu)(?-iu:(?=[{heads}]))", 1) if rule.shape == "assignment" else rule.java_pattern


def rule_hits(rules: tuple[Rule, ...], line: str = "line", lower_line: str = "lower_line") -> Column:
    """Array of the non-empty values of all rules on a line, in catalog order.

    Expects a boolean column ``has_<shape>`` for every guarded shape and one for each of ``SHARED_PARTS``. Written as one SQL expression: the parser builds the 27 branches in one
    call, where composing them call by call takes longer than many scans. No function with a lambda stands around the branches, since what
    is inside of one Spark does not compile: only on lines with a keyword is one evaluated.
    """
    none = f"CAST(array() AS {_HITS})"
    branches = [
        f"CASE WHEN {_worth_trying(lower_line, rule)} THEN transform(array_remove({rule_values(line, rule)}, ''), "
        f"v -> named_struct('ordinal', {ordinal}, 'raw_value', v, 'entropy', CAST(NULL AS DOUBLE))) ELSE {none} END"
        for ordinal, rule in enumerate(rules, 1)
    ]
    if not branches:
        return F.expr(none)
    return F.expr(f"flatten(array({', '.join(branches)}))")


def detect(lines: DataFrame, options: ScanOptions, note: str | None = None) -> DataFrame:
    """Findings of (file_path, line_number, line) rows, one per match.

    With ``note``, a string column: each row that has one passes as a row
    without a rule, whose ``raw_value`` is the note. So one pass over files can
    tell of the files themselves beside their findings.

    No shuffle: a line's rule values, its entropy values and the removal of
    entropy values a rule already reported all happen inside the row. The
    columns are ``FINDING_COLUMNS`` plus ``match_order``, the position of the
    finding on its line (rules in catalog order, then entropy).
    """
    rules = options.rules
    line = F.col("line")
    noted = F.lit(False) if note is None else F.col(note).isNotNull()
    gate = line_gate(line, options)
    candidates = lines if gate is None else lines.where(gate if note is None else gate | noted)
    # Once per surviving line, below the projection that uses them many times.
    shared = {"lower_line": F.lower("line")} | {f"has_{s}": shape_test(line, s) for s in GUARDED_SHAPES}
    kept = scannable(line, options) if note is None else F.coalesce(scannable(line, options), F.lit(False)) | noted
    candidates = candidates.where(kept).withColumns(shared).withColumns({name: F.contains("lower_line", F.lit(part)) for name, part in SHARED_PARTS.items()})

    carried = [] if note is None else [note]
    hits = candidates.select("file_path", "line_number", "line", *carried, rule_hits(rules).alias("rule_hits"))
    found = F.col("rule_hits")
    if options.entropy_enabled:
        fresh = F.array_except(candidate_set(line, options), F.col("rule_hits.raw_value"))
        entropic = F.transform(
            scored_hits(fresh, options),
            lambda h: F.struct(F.lit(0).alias("ordinal"), h["raw_value"].alias("raw_value"), h["entropy"].alias("entropy")),
        )
        found = F.concat(found, F.when(entropy_gate(line, options), entropic).otherwise(F.array().cast(_HITS)))
    if note is not None:
        told = F.struct(F.lit(-1).alias("ordinal"), F.col(note).alias("raw_value"), F.lit(None).cast("double").alias("entropy"))
        found = F.when(noted, F.array(told)).otherwise(found)
    # Exploding an expression, not a column: for a column Spark adds a
    # size(...) > 0 filter that would evaluate all the patterns twice. What is
    # exploded is not compiled, so the hits are a column before.
    every = hits.select("file_path", "line_number", found.alias("found"))
    exploded = every.select("file_path", "line_number", F.posexplode(F.concat("found", F.array().cast(_HITS))).alias("match_order", "hit"))
    findings = _describe(exploded, rules, options)
    return drop_allowlisted_values(findings, options.allowlist)


def _describe(exploded: DataFrame, rules: tuple[Rule, ...], options: ScanOptions) -> DataFrame:
    value, bits, kind = F.col("hit.raw_value"), F.col("hit.entropy"), F.col("kind")
    by_rule = bits.isNull()

    def of_rule(name: str) -> Column:
        known = ", ".join(_sql(getattr(r, name)) for r in rules)
        return F.expr(f"get(CAST(array({known}) AS array<string>), hit.ordinal - 1)")

    # A column of its own: several others are made from it.
    return exploded.withColumn("kind", F.when(~by_rule, string_type(value))).select(
        "file_path",
        "line_number",
        F.when(by_rule, of_rule("rule_id")).otherwise(ENTROPY_RULE_ID).alias("rule_id"),
        F.when(by_rule, of_rule("description"))
        .otherwise(entropy_description(bits, value, options, kind))
        .alias("description"),
        F.when(by_rule, of_rule("severity"))
        .otherwise(entropy_severity(bits, F.length(value), kind))
        .alias("severity"),
        F.when(by_rule, mask_rule_value(value)).otherwise(mask_entropy_value(value)).alias("matched_value"),
        value.alias("raw_value"),
        F.when(by_rule, "regex").otherwise("entropy").alias("detection_method"),
        "match_order",
    )


def drop_allowlisted_values(findings: DataFrame, allowlist: tuple[str, ...]) -> DataFrame:
    """Drop findings whose value equals an allowlisted one, in any case."""
    if not allowlist:
        return findings
    return findings.where(~F.lower("raw_value").isin([v.lower() for v in allowlist]))
