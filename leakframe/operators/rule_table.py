"""Custom rules by the thousand: rules as rows, met through their keywords, in a plan that does not grow with them.

``detect`` has a branch for each rule. Here the rules' keywords are an inverted
index by their first three characters. A line looks up its own triples there,
and only rules with a keyword in the line have their pattern tried on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe.functions.text import mask_rule_value
from leakframe.operators.detect import FINDING_COLUMNS
from leakframe.operators.lines import keep_scannable
from leakframe.options import ScanOptions
from leakframe.rules import Rule, check_patterns

KEY = 3  # characters of a keyword that the index is by
SENT = 100_000  # rows of an index that is sent to the lines

_SCHEMA = (
    "ordinal INT, rule_id STRING, description STRING, severity STRING, pattern STRING, group_idx INT, "
    "keyword STRING, earlier ARRAY<STRING>, triple STRING"
)


def rule_index(spark: SparkSession, rules: list[Rule] | tuple[Rule, ...]) -> DataFrame:
    """A row for each keyword of each rule. Patterns are checked now, not in a task.

    Keywords shorter than the index's key, or none at all, would have a rule
    tried on every line: such rules belong in ``ScanOptions.custom_rules``.
    """
    for rule in rules:
        if not rule.keywords or any(len(k) < KEY for k in rule.keywords):
            raise ValueError(f"rule {rule.rule_id!r} needs keywords of {KEY} characters or more")
    check_patterns(spark, [r.java_pattern for r in rules])
    rows = [
        (ordinal, r.rule_id, r.description, r.severity, r.java_pattern, r.group_idx, keyword, [*r.keywords[:place]], keyword[:KEY])
        for ordinal, r in enumerate(rules, 1) for place, keyword in enumerate(r.keywords)
    ]
    return spark.createDataFrame(rows, _SCHEMA)


def detect_by_table(lines: DataFrame, index: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of (file_path, line_number, line) rows by the rules of ``rule_index``, one per match.

    Lines keep their place where the index has at most ``SENT`` rows and is sent
    to them; otherwise triples meet it by a shuffle that Spark splits where it is
    skewed. Spark is told which, as it knows neither the size of an index made
    from a list nor how many triples lines have: left to itself it may send
    those. A rule is tried once on a line, for the first of its keywords there.
    """
    index = F.broadcast(index) if index.limit(SENT + 1).count() <= SENT else index.hint("merge")
    ll = F.lower("line").alias("ll")
    triples = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("ll") - KEY + 1), lambda i: F.substring(F.col("ll"), i, F.lit(KEY))))
    kept = keep_scannable(lines, options).select("file_path", "line_number", "line", ll).where(F.length("ll") >= KEY)
    met = kept.withColumn("triple", F.explode(triples)).join(index, "triple")
    first = F.contains("ll", F.col("keyword")) & ~F.exists("earlier", lambda k: F.contains(F.col("ll"), k))
    values = F.regexp_extract_all("line", F.col("pattern"), F.col("group_idx"))
    found = met.where(first).select("file_path", "line_number", "ordinal", "rule_id", "description", "severity", F.explode(values).alias("raw_value"))
    out = found.where("raw_value <> ''").withColumns({"matched_value": mask_rule_value(F.col("raw_value")), "detection_method": F.lit("regex")})
    return out.select(*FINDING_COLUMNS)
