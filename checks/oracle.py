"""DuckDB SQL for the operators, written against (file_path, text) sources."""

from __future__ import annotations

import re

from checks.catalog import ASSIGNED, QUOTED, RULES, STANDALONE, Known
from checks.planted import DIRECTIVE

# The white space set in RE2 notation.
WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
FINDING = "file_path, line_number, rule_id, description, severity, matched_value, raw_value, detection_method"
PUBLIC = "file_path AS file, line_number AS line, rule_id, description, severity, matched_value, detection_method"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The pattern with white space spelt out, inside and outside of character classes."""
    spelt = lambda m: m[0].replace(r"\s", WS) if m[0].startswith("[") else f"[{WS}]"
    return lit(re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]|\\s", spelt, pattern))


def lines(source: str) -> str:
    """CTEs ``lines`` and ``kept``: numbered lines, and those that are scanned."""
    return f"""
src AS ({source}),
lines AS (
  SELECT file_path, CAST(u.n AS INTEGER) AS line_number, u.line
  FROM src, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n)
),
kept AS (
  SELECT *, lower(line) AS ll FROM lines
  WHERE regexp_matches(line, {lit(f'[^{WS}]')}) AND NOT contains(line, {lit(DIRECTIVE)})
)"""


def rule_values(rule: Known, ordinal: int = 0, source: str = "kept", keywords: bool = True) -> str:
    flags = ", 'i'" if rule.ignore_case else ""
    where = " OR ".join(f"contains(ll, {lit(k)})" for k in rule.keywords) if keywords and rule.keywords else "true"
    return f"""
SELECT * FROM (
  SELECT file_path, line_number, {ordinal} AS ordinal, {lit(rule.rule_id)} AS rule_id,
    {lit(rule.description)} AS description, {lit(rule.severity)} AS severity,
    unnest(regexp_extract_all(line, {re2(rule.pattern)}, {rule.group_idx}{flags})) AS raw_value
  FROM {source} WHERE {where}
) AS matches WHERE raw_value <> ''"""


def mask(value: str, cap: int | None = None) -> str:
    stars = f"length({value}) - 4" if cap is None else f"least(length({value}) - 4, {cap})"
    return (
        f"CASE WHEN length({value}) <= 4 THEN repeat('*', length({value})) "
        f"ELSE concat(substr({value}, 1, 4), repeat('*', {stars})) END"
    )


def entropy(value: str) -> str:
    share = f"(length({value}) - length(replace({value}, ch, ''))) / length({value})::DOUBLE"
    return (
        f"CASE WHEN {value} = '' THEN 0.0::DOUBLE ELSE "
        f"list_sum(list_transform(list_distinct(string_split({value}, '')), lambda ch: -({share}) * log2({share}))) END"
    )


def string_type(value: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({value}, '[0-9a-fA-F]*') THEN 'hex' "
        f"WHEN regexp_full_match({value}, '[A-Za-z0-9+/=]*') THEN 'base64' ELSE 'generic' END"
    )


def entropy_level(bits: str, value: str, kind: str) -> str:
    score = (
        f"({bits} + CASE WHEN length({value}) > 40 THEN 0.5 WHEN length({value}) > 30 THEN 0.3 ELSE 0.0 END::DOUBLE "
        f"+ CASE WHEN {kind} IN ('hex', 'base64') THEN 0.2 ELSE 0.0 END::DOUBLE)"
    )
    return (
        f"CASE WHEN {score} >= 5.5 THEN 'CRITICAL' WHEN {score} >= 5.0 THEN 'HIGH' "
        f"WHEN {score} >= 4.5 THEN 'MEDIUM' ELSE 'LOW' END"
    )


def candidates(source: str = "kept") -> str:
    """CTEs ``candidates`` and ``entropic``: candidate strings, and those over their threshold."""
    found = "list_concat(list_concat({}), {})".format(
        ", ".join(f"regexp_extract_all(line, {re2(p)}, 1)" for p in (QUOTED, ASSIGNED)),
        f"regexp_extract_all(line, {lit(STANDALONE)}, 1)",
    )
    return f"""
candidates AS (
  SELECT DISTINCT file_path, line_number, raw_value
  FROM (SELECT file_path, line_number, unnest({found}) AS raw_value FROM {source}) AS found
  WHERE length(raw_value) BETWEEN 12 AND 256
),
entropic AS (
  SELECT *, CASE WHEN kind = 'hex' THEN 3.0 ELSE 4.5 END::DOUBLE AS threshold
  FROM (SELECT *, {entropy('raw_value')} AS bits, {string_type('raw_value')} AS kind FROM candidates) AS scored
  WHERE bits >= CASE WHEN kind = 'hex' THEN 3.0 ELSE 4.5 END
)"""


DESCRIPTION = "printf('High entropy %s string detected (entropy: %.2f, threshold: %.2f)', kind, bits, threshold)"


def findings(
    source: str, rules: tuple[Known, ...] = RULES, with_entropy: bool = True, kept: str = "kept",
    extra: str = "",
) -> str:
    """CTEs up to ``findings``: the full scan of a source."""
    per_rule = " UNION ALL ".join(rule_values(r, i, kept) for i, r in enumerate(rules, 1))
    out = f"""{lines(source)}{extra},
rule_hits AS ({per_rule})"""
    union = f"""
  SELECT file_path, line_number, ordinal, rule_id, description, severity, {mask('raw_value', 20)} AS matched_value,
    raw_value, 'regex' AS detection_method FROM rule_hits"""
    if with_entropy:
        out += f",{candidates(kept)}"
        union += f"""
  UNION ALL
  SELECT file_path, line_number, 99 AS ordinal, 'entropy-detection' AS rule_id, {DESCRIPTION} AS description,
    {entropy_level('bits', 'raw_value', 'kind')} AS severity, {mask('raw_value')} AS matched_value,
    raw_value, 'entropy' AS detection_method
  FROM entropic AS e WHERE NOT EXISTS (
    SELECT 1 FROM rule_hits AS r
    WHERE r.file_path = e.file_path AND r.line_number = e.line_number AND r.raw_value = e.raw_value)"""
    return f"{out},\nfindings AS ({union})"


def scan(source: str, select: str = f"SELECT {FINDING} FROM findings", **how) -> str:
    return f"WITH {findings(source, **how)}\n{select}"
