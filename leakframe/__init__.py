"""Secret scanning as Spark DataFrame operators."""

from leakframe.operators.findings import should_block, summary, verdict
from leakframe.operators.state import StateTable
from leakframe.options import ScanOptions
from leakframe.plans.scan import current_findings, scan_changed, scan_configured, scan_files, scan_table, scan_texts
from leakframe.rules import Rule, check_patterns, rule_catalog
from leakframe.sources.sinks import write_findings, write_report
from leakframe.streaming.gate import scan_stream, stream_gate, stream_skip_seen, watch_files

__all__ = [
    "Rule", "ScanOptions", "StateTable", "check_patterns", "current_findings", "rule_catalog", "scan_changed", "scan_configured",
    "scan_files", "scan_stream", "scan_table", "scan_texts", "should_block", "stream_gate", "stream_skip_seen", "summary",
    "verdict", "watch_files", "write_findings", "write_report",
]
