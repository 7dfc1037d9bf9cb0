"""Scan options: one frozen dataclass, overridden with ``dataclasses.replace``."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from leakframe.rules import BUILTIN_RULES, RULE_GROUPS, Rule
from leakframe.severity import parse_severity

# Extensions and leading bytes that mark a file as binary.
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a",
    ".pyc", ".pyo", ".class", ".jar",
    ".mp3", ".mp4", ".avi", ".mov", ".mkv", ".flac", ".wav",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
    ".sqlite", ".db", ".lock",
)
BINARY_SIGNATURES = (
    b"\x89PNG", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"PK\x03\x04", b"PK\x05\x06",
    b"\x1f\x8b", b"BZ", b"\x7fELF", b"MZ", b"\xca\xfe\xba\xbe", b"\xfe\xed\xfa",
    b"\x00\x00\x01\x00", b"\x00\x00\x02\x00", b"RIFF", b"%PDF", b"\xd0\xcf\x11\xe0", b"SQLite format",
)
NUL_SAMPLE_BYTES = 8192


@dataclass(frozen=True)
class ScanOptions:
    """Everything that changes what a scan reports.

    ``ignore_directive`` is the literal that switches a line off;
    ``ignore_line_patterns`` are Java patterns that do the same.
    ``allowlist`` holds values that are never reported (any case); long lists
    belong in a table, see ``operators.allowlist``. ``rule_ids`` narrows the
    catalog below the group toggles. ``max_file_bytes`` leaves larger files out,
    as rows with a reason; by default there is no cap. The last four say what
    ``plans.scan.scan_configured`` does: nothing unless ``enabled``, only changed
    files if ``cache_enabled`` and there is a ``cache_path`` for the state, and a
    report if there is a ``report_path``.
    """

    rule_groups: tuple[str, ...] = RULE_GROUPS
    rule_ids: tuple[str, ...] | None = None
    custom_rules: tuple[Rule, ...] = ()
    entropy_enabled: bool = True
    # The default thresholds and lengths.
    entropy_threshold: float = 4.5
    hex_entropy_threshold: float = 3.0
    min_length: int = 12
    max_length: int = 256
    ignore_directive: str = "leakframe:ignore"
    ignore_line_patterns: tuple[str, ...] = ()
    allowlist: tuple[str, ...] = ()
    ignore_globs: tuple[str, ...] = ()
    skip_binary: bool = True
    binary_extensions: tuple[str, ...] = BINARY_EXTENSIONS
    binary_signatures: tuple[bytes, ...] = BINARY_SIGNATURES
    max_file_bytes: int | None = None
    block_level: str = "HIGH"
    enabled: bool = True
    cache_enabled: bool = True
    cache_path: str | None = None
    report_path: str | None = None

    def __post_init__(self):
        unknown = set(self.rule_groups) - set(RULE_GROUPS)
        if unknown:
            raise ValueError(f"unknown rule groups {sorted(unknown)}; valid values: {list(RULE_GROUPS)}")
        object.__setattr__(self, "block_level", parse_severity(self.block_level))

    @property
    def rules(self) -> tuple[Rule, ...]:
        """Rules in force, in evaluation order: enabled built-ins, then custom ones."""
        builtin = [r for r in BUILTIN_RULES if r.group in self.rule_groups]
        chosen = (*builtin, *self.custom_rules)
        if self.rule_ids is not None:
            chosen = tuple(r for r in chosen if r.rule_id in self.rule_ids)
        return tuple(chosen)

    @property
    def rule_set_id(self) -> str:
        """Changes whenever a re-scan of the same content could report something else."""
        shown = [
            f"{f.name}={getattr(self, f.name)!r}"
            for f in fields(self)
            if f.name not in ("rule_groups", "rule_ids", "custom_rules", "block_level", "enabled", "cache_enabled", "cache_path", "report_path")
        ]
        return hashlib.sha256(repr((shown, self.rules)).encode()).hexdigest()

    def override(self, sections: Mapping[str, Any]) -> "ScanOptions":
        """Apply a nested mapping of sections; what it does not name stays as it is."""
        known = {"rules": set(RULE_GROUPS)}
        for section, name, *_ in _SECTIONS:
            known.setdefault(section, set()).add(name)
        sections = dict(sections)
        top = {"": {"enabled": sections.pop("enabled")}} if "enabled" in sections else {}
        sections |= top
        for section, values in sections.items():
            unknown = {section} - known.keys() or set(values) - known[section]
            if unknown:
                raise ValueError(f"unknown options {sorted(unknown)} in section {section!r}; valid: {sorted(known.get(section, known))}")
        changes: dict[str, Any] = {}
        for section, name, option, convert in _SECTIONS:
            if name in sections.get(section, {}):
                changes[option] = convert(sections[section][name])
        toggles = sections.get("rules", {})
        if toggles:
            changes["rule_groups"] = tuple(
                g for g in RULE_GROUPS if toggles.get(g, g in self.rule_groups)
            )
        return replace(self, **changes)


# Section and option names of the nested form; ``enabled`` stands outside the sections.
_SECTIONS = (
    ("", "enabled", "enabled", bool),
    ("cache", "enabled", "cache_enabled", bool),
    ("cache", "path", "cache_path", str),
    ("reporting", "output_dir", "report_path", str),
    ("scanning", "max_file_size_mb", "max_file_bytes", lambda mb: int(mb * 1024 * 1024)),
    ("scanning", "skip_binary", "skip_binary", bool),
    ("entropy", "enabled", "entropy_enabled", bool),
    ("entropy", "threshold", "entropy_threshold", float),
    ("entropy", "hex_threshold", "hex_entropy_threshold", float),
    ("entropy", "min_length", "min_length", int),
    ("entropy", "max_length", "max_length", int),
    ("severity", "block_level", "block_level", str),
    ("allowlist", "values", "allowlist", tuple),
    ("allowlist", "patterns", "ignore_line_patterns", tuple),
    ("allowlist", "files", "ignore_globs", tuple),
)
