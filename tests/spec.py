"""Plain-Python specification of line scanning, for differential tests only."""

import math
import re
from collections import Counter

from leakframe.operators.entropy import ASSIGNED, QUOTED, STANDALONE
from leakframe.options import ScanOptions


def entropy(text):
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) if text else 0.0


def kind(text):
    if re.fullmatch(r"[0-9a-fA-F]*", text):
        return "hex"
    return "base64" if re.fullmatch(r"[A-Za-z0-9+/=]*", text) else "generic"


def level(bits, length, text_kind):
    score = bits + (0.5 if length > 40 else 0.3 if length > 30 else 0) + (0.2 if text_kind != "generic" else 0)
    return "CRITICAL" if score >= 5.5 else "HIGH" if score >= 5 else "MEDIUM" if score >= 4.5 else "LOW"


def stars(value, cap=None):
    hidden = len(value) - 4
    return "*" * len(value) if hidden <= 0 else value[:4] + "*" * (hidden if cap is None else min(hidden, cap))


def candidates(line, options):
    found = [v for p in (QUOTED, ASSIGNED, STANDALONE) for v in re.findall(p, line)]
    return {v for v in found if options.min_length <= len(v) <= options.max_length}


def scan(key, text, options=ScanOptions()):
    """Sorted (key, line, rule, severity, masked, raw, method) tuples."""
    out = []
    allowed = {v.lower() for v in options.allowlist}
    for number, line in enumerate(text.split("\n"), 1):
        if not line.strip() or options.ignore_directive in line:
            continue
        if any(re.search(p, line) for p in options.ignore_line_patterns):
            continue
        seen = set()
        for rule in options.rules:
            if rule.keywords and not any(k in line.lower() for k in rule.keywords):
                continue
            pattern = re.compile(rule.pattern, re.I if rule.ignore_case else 0)
            for m in pattern.finditer(line):
                value = m.group(rule.group_idx) or ""
                if value and value.lower() not in allowed:
                    seen.add(value)
                    out.append((key, number, rule.rule_id, rule.severity, stars(value, 20), value, "regex"))
        if not options.entropy_enabled:
            continue
        for value in candidates(line, options) - seen:
            bits, text_kind = entropy(value), kind(value)
            least = options.hex_entropy_threshold if text_kind == "hex" else options.entropy_threshold
            if bits >= least and value.lower() not in allowed:
                severity = level(bits, len(value), text_kind)
                out.append((key, number, "entropy-detection", severity, stars(value), value, "entropy"))
    return sorted(out)


def spark_rows(findings):
    rows = findings.select(
        "file_path", "line_number", "rule_id", "severity", "matched_value", "raw_value", "detection_method"
    ).collect()
    return sorted(tuple(r) for r in rows)
