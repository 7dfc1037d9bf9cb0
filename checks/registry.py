"""Every registered query, with the DuckDB SQL for the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle as sql
from checks.catalog import RULES
from checks.planted import RECIPES, customer_files, customer_files_sql, order_lines, order_lines_sql
from leakframe.functions import paths, text
from leakframe.operators import entropy, filefilter, findings, lines, state
from leakframe.operators.allowlist import drop_allowlisted
from leakframe.operators.rule_table import detect_by_table, rule_index
from leakframe.options import ScanOptions
from leakframe.plans.scan import current_findings, scan_changed, scan_files, scan_selected, scan_texts
from leakframe.rules import BUILTIN_RULES, Rule, rule_catalog
from leakframe.severity import severity_level, severity_rank
from leakframe.sources.files import changed_paths, file_rows, ignore_patterns, read_files, skipped_files
from leakframe.sources.shared import shared_folder
from leakframe.sources.sinks import write_findings, write_report
from leakframe.sources.tables import read_texts, spread
from leakframe.streaming.gate import scan_stream, stream_gate, stream_skip_seen, watch_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DOCUMENTS = "SELECT cast(doc_id AS string) AS file_path, text FROM documents"
PAGES = "SELECT cast(page_id AS string) AS file_path, html AS text FROM pages"
TURNS = "SELECT concat(conv_id, '/', turn) AS file_path, text FROM conversations"
PROPS = "SELECT cast(event_id AS string) AS file_path, props AS text FROM events"
BENCHMARK = "SELECT cast(item_id AS string) AS file_path, text FROM benchmark"
FILES = customer_files_sql()
FINDING = sql.FINDING.split(", ")


def register(name: str, oracle: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_files(spread(table(spark, sf_dir, "customer")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_texts(spark, f"{sf_dir}/pages.parquet", "page_id", "html")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", "conv_id", "turn")
    return read_texts(spark, f"{sf_dir}/conversations.parquet", key, "text")


def file_lines(spark: SparkSession, sf_dir: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    return lines.keep_scannable(lines.split_lines(files(spark, sf_dir)), options)


def file_findings(spark: SparkSession, sf_dir: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    return scan_texts(files(spark, sf_dir), options)


# Rules: one planted line per order and rule.


def _rule_query(rule: Rule) -> None:
    options = ScanOptions(rule_ids=(rule.rule_id,), entropy_enabled=False)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = order_lines(spread(table(spark, sf_dir, "orders")), rule.rule_id)
        return scan_texts(source, options).select(*FINDING)

    QUERIES[f"rule_{rule.rule_id}"] = query
    ORACLES[f"rule_{rule.rule_id}"] = sql.scan(
        order_lines_sql(rule.rule_id), rules=tuple(k for k in RULES if k.rule_id == rule.rule_id), with_entropy=False
    )


assert list(RECIPES) == [r.rule_id for r in BUILTIN_RULES]
for _rule in BUILTIN_RULES:
    _rule_query(_rule)


# Scans of whole tables.


@register("scan_documents", sql.scan(DOCUMENTS))
def scan_documents(spark, sf_dir):
    return scan_texts(documents(spark, sf_dir)).select(*FINDING)


@register("scan_pages", sql.scan(PAGES))
def scan_pages(spark, sf_dir):
    return scan_texts(pages(spark, sf_dir)).select(*FINDING)


@register("scan_conversations", sql.scan(TURNS))
def scan_conversations(spark, sf_dir):
    return scan_texts(turns(spark, sf_dir)).select(*FINDING)


@register("scan_events", sql.scan(PROPS))
def scan_events(spark, sf_dir):
    return scan_texts(read_texts(spark, f"{sf_dir}/events.parquet", "event_id", "props")).select(*FINDING)


@register("scan_benchmark", sql.scan(BENCHMARK))
def scan_benchmark(spark, sf_dir):
    return scan_texts(read_texts(spark, f"{sf_dir}/benchmark.parquet", "item_id", "text")).select(*FINDING)


@register("scan_rules_only", sql.scan(DOCUMENTS, with_entropy=False))
def scan_rules_only(spark, sf_dir):
    return scan_texts(documents(spark, sf_dir), ScanOptions(entropy_enabled=False)).select(*FINDING)


@register("scan_full", sql.scan(FILES))
def scan_full(spark, sf_dir):
    return file_findings(spark, sf_dir).select(*FINDING)


@register("union_of_detectors", sql.scan(FILES, """
SELECT file_path, line_number, detection_method, count(*) AS findings FROM findings
GROUP BY file_path, line_number, detection_method"""))
def union_of_detectors(spark, sf_dir):
    return file_findings(spark, sf_dir).groupBy("file_path", "line_number", "detection_method").agg(
        F.count(F.lit(1)).alias("findings")
    )


@register("rule_catalog", sql.scan(FILES, f"""
SELECT CAST(c.ordinal AS INTEGER) AS ordinal, c.rule_id, c.description, c.severity, count(f.rule_id) AS findings
FROM (VALUES {", ".join(f"({i}, {sql.lit(r.rule_id)}, {sql.lit(r.description)}, {sql.lit(r.severity)})" for i, r in enumerate(RULES, 1))})
  AS c(ordinal, rule_id, description, severity)
LEFT JOIN findings AS f ON f.rule_id = c.rule_id GROUP BY ALL"""))
def catalog_use(spark, sf_dir):
    counts = file_findings(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return rule_catalog(spark).join(counts, "rule_id", "left").select(
        "ordinal", "rule_id", "description", "severity", F.coalesce("n", F.lit(0)).alias("findings")
    )


@register("rule_toggle", sql.scan(FILES, rules=tuple(r for r in RULES if r.group in ("aws", "github")), with_entropy=False))
def rule_toggle(spark, sf_dir):
    options = ScanOptions(entropy_enabled=False).override({"rules": {"jwt": False, "generic": False}})
    return file_findings(spark, sf_dir, options).select(*FINDING)


CUSTOM = Rule("order-code", "custom", "MEDIUM", "Internal digest", r"digest\s+([0-9a-f]{8})([0-9a-f]{8})", ("digest",))


@register("custom_rule", sql.scan(FILES, rules=(CUSTOM,), with_entropy=False))
def custom_rule(spark, sf_dir):
    options = ScanOptions(rule_groups=(), entropy_enabled=False, custom_rules=(CUSTOM,))
    return file_findings(spark, sf_dir, options).select(*FINDING)


# Lines.


@register("line_split", f"WITH {sql.lines(DOCUMENTS)} SELECT file_path, line_number, line FROM lines")
def line_split(spark, sf_dir):
    return lines.split_lines(documents(spark, sf_dir))


@register("blank_lines", f"""WITH {sql.lines(FILES)}
SELECT file_path, line_number, regexp_matches(line, {sql.lit(f'[^{sql.WS}]')}) = false AS is_blank FROM lines""")
def blank_lines(spark, sf_dir):
    return lines.split_lines(files(spark, sf_dir)).select(
        "file_path", "line_number", text.is_blank(F.col("line")).alias("is_blank")
    )


@register("ignore_directive", f"""WITH {sql.lines(FILES)}
SELECT file_path, line_number, line FROM lines WHERE contains(line, 'leakframe:ignore')""")
def ignore_directive(spark, sf_dir):
    return lines.split_lines(files(spark, sf_dir)).where(lines.has_directive(F.col("line"), "leakframe:ignore"))


IGNORED_LINES = (r"^use\s", r"_password\b")


@register("ignore_line_regex", sql.scan(FILES, kept="wanted", extra=f""",
wanted AS (SELECT * FROM kept WHERE NOT regexp_matches(line, {sql.re2(IGNORED_LINES[0])})
  AND NOT regexp_matches(line, {sql.lit(IGNORED_LINES[1])}))"""))
def ignore_line_regex(spark, sf_dir):
    return file_findings(spark, sf_dir, ScanOptions(ignore_line_patterns=IGNORED_LINES)).select(*FINDING)


HALF_EMPTY = Rule("maybe-empty", "custom", "low", "Letters after a key", r"api_key=([A-F]*)", ("api_key",))


@register("empty_match_drop", sql.scan(FILES, rules=(HALF_EMPTY,), with_entropy=False))
def empty_match_drop(spark, sf_dir):
    """A group that matches nothing on part of the lines."""
    options = ScanOptions(rule_groups=(), entropy_enabled=False, custom_rules=(HALF_EMPTY,))
    return file_findings(spark, sf_dir, options).select(*FINDING)


MANY = 2000


@register("many_rules", f"""WITH {sql.lines(FILES)},
rules AS (SELECT i, printf('%04x', i) AS keyword FROM range({MANY}) AS r(i))
SELECT * FROM (
  SELECT file_path, line_number, concat('code-', keyword) AS rule_id,
    unnest(regexp_extract_all(line, concat(keyword, '([0-9a-f]{{5}})'), 1)) AS raw_value
  FROM kept JOIN rules ON contains(ll, keyword)) AS found""")
def many_rules(spark, sf_dir):
    """Two thousand custom rules as a table."""
    rules = [Rule(f"code-{i:04x}", "custom", "LOW", "A code", f"{i:04x}([0-9a-f]{{5}})", (f"{i:04x}",)) for i in range(MANY)]
    found = detect_by_table(lines.split_lines(files(spark, sf_dir)), rule_index(spark, rules))
    return found.select("file_path", "line_number", "rule_id", "raw_value")


DB_PASSWORD = next(r for r in BUILTIN_RULES if r.rule_id == "database-password")
KNOWN_PASSWORD = next(r for r in RULES if r.rule_id == "database-password")


@register("keyword_gap", f"""WITH {sql.lines(FILES)},
by_pattern AS ({sql.rule_values(KNOWN_PASSWORD, keywords=False)}),
by_rule AS ({sql.rule_values(KNOWN_PASSWORD)})
SELECT p.file_path, p.line_number, p.raw_value, count(r.raw_value) > 0 AS reported
FROM by_pattern AS p LEFT JOIN (SELECT DISTINCT file_path, line_number, raw_value FROM by_rule) AS r
  USING (file_path, line_number, raw_value)
GROUP BY p.file_path, p.line_number, p.raw_value""")
def keyword_gap(spark, sf_dir):
    """Values the pattern accepts, and whether the rule's keywords let it report them."""
    from dataclasses import replace

    open_rule = replace(DB_PASSWORD, rule_id="open", keywords=(), shape=None)
    options = ScanOptions(rule_ids=("open", DB_PASSWORD.rule_id), custom_rules=(open_rule,), entropy_enabled=False)
    return file_findings(spark, sf_dir, options).groupBy("file_path", "line_number", "raw_value").agg(
        F.bool_or(F.col("rule_id") == DB_PASSWORD.rule_id).alias("reported")
    )


@register("allowlist_table", sql.scan(FILES, f"""SELECT {sql.FINDING} FROM findings
WHERE lower(raw_value) NOT IN (SELECT lower(substr(md5(cast(c_custkey AS string)), 1, 10)) FROM customer
  WHERE c_mktsegment <> 'MACHINERY')"""))
def allowlist_table(spark, sf_dir):
    allowed = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select(
        F.upper(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 10)).alias("value")
    )
    return drop_allowlisted(file_findings(spark, sf_dir), allowed).select(*FINDING)


# The tables' own tokens are unknown here, so the listed values are planted ones.
ALLOWED = ("C4CA4238A0", "c81e728d9d", "a87ff679a2", "E4DA3B7FBB")


@register("allowlist", sql.scan(FILES, f"""SELECT {sql.FINDING} FROM findings
WHERE lower(raw_value) NOT IN ({", ".join(sql.lit(v.lower()) for v in ALLOWED)})"""))
def allowlist(spark, sf_dir):
    return file_findings(spark, sf_dir, ScanOptions(allowlist=ALLOWED)).select(*FINDING)


# Entropy.

NUMBERED = "file_path, line_number"


def _candidate_query(name: str, pattern: str, column) -> None:
    @register(f"candidates_{name}", f"""WITH {sql.lines(FILES)}
SELECT {NUMBERED}, unnest(regexp_extract_all(line, {sql.re2(pattern)}, 1)) AS candidate FROM kept""")
    def query(spark, sf_dir):
        return file_lines(spark, sf_dir).select(
            "file_path", "line_number", F.explode(column(F.col("line"))).alias("candidate")
        )


_candidate_query("quoted", entropy.QUOTED, entropy.quoted_candidates)
_candidate_query("assigned", entropy.ASSIGNED, entropy.assigned_candidates)
_candidate_query("standalone", entropy.STANDALONE, entropy.standalone_candidates)


def candidate_rows(spark, sf_dir):
    return file_lines(spark, sf_dir).select(
        "file_path", "line_number", F.explode(entropy.candidate_set(F.col("line"), ScanOptions())).alias("candidate")
    )


CANDIDATES = f"WITH {sql.lines(FILES)},{sql.candidates()}"


@register("candidate_set", f"{CANDIDATES} SELECT {NUMBERED}, raw_value AS candidate FROM candidates")
def candidate_set(spark, sf_dir):
    return candidate_rows(spark, sf_dir)


@register("shannon_entropy", f"""
SELECT cast(doc_id AS string) AS file_path, round_even({sql.entropy('text')}, 4) AS entropy FROM documents""")
def shannon_entropy(spark, sf_dir):
    """Entropy of whole texts."""
    return documents(spark, sf_dir).select(
        "file_path", F.bround(text.shannon_entropy(F.col("text")), 4).alias("entropy")
    )


@register("shannon_entropy_candidates", f"""{CANDIDATES}
SELECT {NUMBERED}, raw_value AS candidate, round_even({sql.entropy('raw_value')}, 4) AS entropy FROM candidates""")
def shannon_entropy_candidates(spark, sf_dir):
    return candidate_rows(spark, sf_dir).withColumn(
        "entropy", F.bround(text.shannon_entropy(F.col("candidate")), 4)
    )


@register("classify_string", f"""{CANDIDATES}
SELECT {NUMBERED}, raw_value AS candidate, {sql.string_type('raw_value')} AS string_type,
  regexp_full_match(raw_value, '[0-9a-fA-F]*') AS is_hex, regexp_full_match(raw_value, '[A-Za-z0-9+/=]*') AS is_base64
FROM candidates""")
def classify_string(spark, sf_dir):
    value = F.col("candidate")
    return candidate_rows(spark, sf_dir).withColumns({
        "string_type": text.string_type(value), "is_hex": text.is_hex(value), "is_base64": text.is_base64(value),
    })


@register("entropy_threshold", f"{CANDIDATES} SELECT {NUMBERED}, raw_value, threshold FROM entropic")
def entropy_threshold(spark, sf_dir):
    options = ScanOptions()
    hits = entropy.entropy_hits(file_lines(spark, sf_dir), options)
    return hits.select(
        "file_path", F.col("line").alias("line_number"), "raw_value",
        entropy.threshold(F.col("raw_value"), options).alias("threshold"),
    )


@register("entropy_hits", f"""{CANDIDATES}
SELECT file_path, 'High Entropy String' AS type, {sql.mask('raw_value')} AS value, raw_value, line_number AS line,
  round_even(bits, 4) AS entropy, kind AS string_type, {sql.entropy_level('bits', 'raw_value', 'kind')} AS severity,
  {sql.DESCRIPTION} AS description
FROM entropic""")
def entropy_hits(spark, sf_dir):
    return entropy.entropy_hits(file_lines(spark, sf_dir), ScanOptions())


@register("entropy_severity", f"""{CANDIDATES}
SELECT {NUMBERED}, raw_value AS candidate,
  {sql.entropy_level(sql.entropy('raw_value'), 'raw_value', sql.string_type('raw_value'))} AS severity
FROM candidates""")
def entropy_severity(spark, sf_dir):
    value = F.col("candidate")
    level = entropy.entropy_severity(text.shannon_entropy(value), F.length(value), text.string_type(value))
    return candidate_rows(spark, sf_dir).withColumn("severity", level)


@register("entropy_switch", sql.scan(FILES, f"SELECT {sql.FINDING} FROM findings WHERE detection_method = 'entropy'", rules=(CUSTOM,)))
def entropy_switch(spark, sf_dir):
    """Entropy branch alone, beside one custom rule."""
    options = ScanOptions(rule_groups=(), custom_rules=(CUSTOM,))
    return file_findings(spark, sf_dir, options).where(F.col("detection_method") == "entropy").select(*FINDING)


@register("mask_rule", f"{CANDIDATES} SELECT {NUMBERED}, raw_value AS candidate, {sql.mask('raw_value', 20)} AS masked FROM candidates")
def mask_rule(spark, sf_dir):
    return candidate_rows(spark, sf_dir).withColumn("masked", text.mask_rule_value(F.col("candidate")))


@register("mask_entropy", f"{CANDIDATES} SELECT {NUMBERED}, raw_value AS candidate, {sql.mask('raw_value')} AS masked FROM candidates")
def mask_entropy(spark, sf_dir):
    return candidate_rows(spark, sf_dir).withColumn("masked", text.mask_entropy_value(F.col("candidate")))


@register("suppress_duplicates", f"""WITH {sql.findings(FILES)}
SELECT e.file_path, e.line_number, e.raw_value, e.raw_value NOT IN (
    SELECT r.raw_value FROM rule_hits AS r WHERE r.file_path = e.file_path AND r.line_number = e.line_number) AS reported
FROM entropic AS e""")
def suppress_duplicates(spark, sf_dir):
    """High-entropy strings, and whether no rule reported the same value on the line.

    Sizes are estimated from the customers, of which each makes many findings, so
    that Spark would take the findings for few and send them all through the driver.
    """
    hits = entropy.entropy_hits(file_lines(spark, sf_dir), ScanOptions())
    kept = (
        file_findings(spark, sf_dir).where(F.col("detection_method") == "entropy")
        .select("file_path", F.col("line_number").alias("line"), "raw_value", F.lit(True).alias("kept"))
    )
    return hits.join(kept.hint("merge"), ["file_path", "line", "raw_value"], "left").select(
        "file_path", F.col("line").alias("line_number"), "raw_value", F.coalesce("kept", F.lit(False)).alias("reported")
    )


# Roll-ups.

LEVELS = "(VALUES ('LOW', 1, 'Warning'), ('MEDIUM', 2, 'Warning + Confirmation'), ('HIGH', 3, 'Commit Block'), ('CRITICAL', 4, 'Force Block')) AS d(severity, rank, action)"


@register("severity_counts", sql.scan(FILES, f"""
SELECT d.severity, count(f.rule_id) AS findings FROM {LEVELS} LEFT JOIN findings AS f ON f.severity = d.severity
GROUP BY d.severity"""))
def severity_counts(spark, sf_dir):
    return findings.severity_counts(file_findings(spark, sf_dir))


@register("severity_counts_documents", sql.scan(DOCUMENTS, f"""
SELECT d.severity, count(f.rule_id) AS findings FROM {LEVELS} LEFT JOIN findings AS f ON f.severity = d.severity
GROUP BY d.severity"""))
def severity_counts_documents(spark, sf_dir):
    return findings.severity_counts(scan_texts(documents(spark, sf_dir)))


@register("total_findings", sql.scan(FILES, "SELECT count(*) AS total FROM findings"))
def total_findings(spark, sf_dir):
    return findings.total_findings(file_findings(spark, sf_dir))


@register("max_severity", sql.scan(FILES, f"""
SELECT max_by(d.severity, d.rank) AS max_severity FROM findings AS f JOIN {LEVELS} ON d.severity = f.severity"""))
def max_severity(spark, sf_dir):
    return findings.max_severity(file_findings(spark, sf_dir))


@register("block_verdict", sql.scan(FILES, """
SELECT coalesce(bool_or(severity IN ('HIGH', 'CRITICAL')), false) AS should_block FROM findings"""))
def block_verdict(spark, sf_dir):
    return findings.verdict(file_findings(spark, sf_dir))


@register("block_verdict_clean", sql.scan(TURNS, """
SELECT coalesce(bool_or(severity = 'CRITICAL'), false) AS should_block FROM findings"""))
def block_verdict_clean(spark, sf_dir):
    return findings.verdict(scan_texts(turns(spark, sf_dir)), "critical")


@register("files_affected", sql.scan(FILES, "SELECT DISTINCT file_path FROM findings"))
def files_affected(spark, sf_dir):
    return findings.files_affected(file_findings(spark, sf_dir))


@register("findings_by_severity", sql.scan(FILES, f"SELECT {sql.FINDING} FROM findings WHERE upper(severity) = 'HIGH'"))
def findings_by_severity(spark, sf_dir):
    return findings.with_severity(file_findings(spark, sf_dir), "high").select(*FINDING)


@register("findings_by_file", sql.scan(
    "SELECT source AS file_path, text FROM documents", "SELECT * FROM ("
    "SELECT file_path, line_number, rule_id, severity, raw_value FROM findings) AS f WHERE file_path = 'src7'"))
def findings_by_file(spark, sf_dir):
    """Documents labelled by their source; the label is compared exactly."""
    labelled = read_texts(spark, f"{sf_dir}/documents.parquet", "source", "text")
    return findings.in_file(scan_texts(labelled), "src7").select(
        "file_path", "line_number", "rule_id", "severity", "raw_value"
    )


@register("findings_per_file", sql.scan(DOCUMENTS, """
SELECT s.file_path, count(f.rule_id) AS findings_count FROM src AS s LEFT JOIN findings AS f USING (file_path)
GROUP BY s.file_path"""))
def findings_per_file(spark, sf_dir):
    source = documents(spark, sf_dir)
    return findings.findings_per_file(source, scan_texts(source))


@register("severity_action", sql.scan(FILES, f"""
SELECT f.file_path, f.line_number, f.rule_id, f.severity, CAST(d.rank AS INTEGER) AS severity_rank, d.action
FROM findings AS f JOIN {LEVELS} ON d.severity = f.severity"""))
def severity_action(spark, sf_dir):
    return findings.with_action(file_findings(spark, sf_dir)).select(
        "file_path", "line_number", "rule_id", "severity", "severity_rank", "action"
    )


@register("summary_row", sql.scan(FILES, """
SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low,
  coalesce(bool_or(severity IN ('HIGH', 'CRITICAL')), false) AS should_block,
  max_by(severity, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS max_severity,
  count(DISTINCT file_path) AS files_affected
FROM findings"""))
def summary_row(spark, sf_dir):
    row = findings.summary(file_findings(spark, sf_dir))
    counts = {level.lower(): F.col("by_severity")[level] for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW")}
    return row.withColumns(counts).drop("by_severity")


@register("public_findings", sql.scan(FILES, """
SELECT file_path AS file, line_number AS line, rule_id, description, severity, matched_value, detection_method
FROM findings"""))
def public_findings(spark, sf_dir):
    return findings.public_findings(file_findings(spark, sf_dir))


@register("alert_lines", sql.scan(FILES, """
SELECT concat('Possible ', rule_id, ' or sensitive data detected at line ', line_number, ' of file ', file_path) AS alert,
  concat('[', severity, '] ', file_path, ':', line_number, ' - ', rule_id, ': ', matched_value) AS gate_line
FROM findings"""))
def alert_lines(spark, sf_dir):
    return findings.alert_lines(file_findings(spark, sf_dir))


@register("finding_order", sql.scan(FILES, """
SELECT file_path, line_number, CAST(row_number() OVER (PARTITION BY file_path, line_number ORDER BY ordinal) - 1 AS INTEGER)
  AS match_order, rule_id FROM findings ORDER BY 1, 2, 3"""))
def finding_order(spark, sf_dir):
    return findings.in_order(file_findings(spark, sf_dir)).select("file_path", "line_number", "match_order", "rule_id")


# Paths and file content, derived from the tables.

# One of sixteen names per page, by the first hex digit of its key's MD5.
NAMES = (
    "a.PNG", ".env", "x.tar.gz", ".x.db", "main.py", "Makefile", "debug.log", "poetry.lock", "..odd", "n.svg",
    "data.json", "b[1].log", "vendor", "no.ext.", "lib.so", "app.min.js",
)
_NAME = "CASE substr(md5(cast(page_id AS string)), 1, 1) {} END".format(
    " ".join(f"WHEN '{format(i, 'x')}' THEN {sql.lit(n)}" for i, n in enumerate(NAMES))
)
_FOLDER = "CASE WHEN url LIKE 'https:%' THEN 'src' ELSE 'vendor/lib' END"
_PATH = f"concat('/repo/', {_FOLDER}, '/', page_id, '/', {_NAME})"
PAGE_PATHS = f"(SELECT {_PATH} AS path FROM pages) AS p"


def page_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.expr(_PATH).alias("path"))


BASE = "regexp_extract(path, '([^/]*)$', 1)"
EXTENSION = rf"lower(regexp_extract({BASE}, '^\.*[^.].*?(\.[^.]*)$', 1))"


@register("path_parts", f"SELECT path, {BASE} AS name, {EXTENSION} AS extension FROM {PAGE_PATHS}")
def path_parts(spark, sf_dir):
    path = F.col("path")
    return page_paths(spark, sf_dir).select(
        "path", paths.basename(path).alias("name"), paths.extension(path).alias("extension")
    )


@register("binary_extension", f"""SELECT path, {EXTENSION} IN ({", ".join(map(sql.lit, ScanOptions().binary_extensions))})
AS is_binary FROM {PAGE_PATHS}""")
def binary_extension(spark, sf_dir):
    return page_paths(spark, sf_dir).withColumn(
        "is_binary", filefilter.has_binary_extension(F.col("path"), ScanOptions())
    )


@register("ignore_globs", f"""
SELECT path, path LIKE '%.log' OR path LIKE 'src/%main.py' OR substr(path, 7) LIKE 'src/%main.py'
  OR {BASE} LIKE 'debug.___' OR regexp_matches({BASE}, '^[a-c]\\.[^l]..$') OR {BASE} = 'Makefile'
  OR starts_with(path, 'vendor/') OR starts_with(substr(path, 7), 'vendor/') AS is_ignored
FROM {PAGE_PATHS}""")
def ignore_globs(spark, sf_dir):
    globs = ("*.log", "src/*main.py", "debug.???", "[a-c].[!l]??", "Makefile", "vendor/")
    path = F.col("path")
    return page_paths(spark, sf_dir).withColumn(
        "is_ignored", filefilter.is_ignored(path, paths.below(path, "/repo"), ScanOptions(ignore_globs=globs))
    )


@register("dir_prefix", f"SELECT path, starts_with(path, '/repo/vendor/') AS is_ignored FROM {PAGE_PATHS}")
def dir_prefix(spark, sf_dir):
    return page_paths(spark, sf_dir).withColumn("is_ignored", paths.matches_globs(F.col("path"), ["/repo/vendor/"]))


@register("path_normalise", f"""
SELECT messy, concat('/repo/', page_id, '/', name) AS path
FROM (SELECT page_id, {_NAME} AS name, concat('file:/repo//x/.././', page_id, '/y/..//', {_NAME}) AS messy FROM pages) AS p""")
def path_normalise(spark, sf_dir):
    messy = F.expr(f"concat('file:/repo//x/.././', page_id, '/y/..//', {_NAME})")
    return table(spark, sf_dir, "pages").select(messy.alias("messy")).withColumn(
        "path", paths.normalise(F.col("messy"))
    )


# One of eight openings per document; the last three do not mark a file as binary.
OPENINGS = ("BZ", "MZ", "RIFF", "GIF89a", "%PDF", "mz", "PNG", "")
_OPENING = "CASE substr(md5(cast(doc_id AS string)), 1, 1) {} ELSE '' END".format(
    " ".join(f"WHEN '{format(i, 'x')}' THEN '{o}'" for i, o in enumerate(OPENINGS))
)


@register("binary_signature", f"""
SELECT file_path, regexp_matches(content, '^(BZ|MZ|RIFF|GIF89a|%PDF)') AS is_binary
FROM (SELECT cast(doc_id AS string) AS file_path, concat({_OPENING}, text) AS content FROM documents) AS d""")
def binary_signature(spark, sf_dir):
    content = F.expr(f"cast(concat({_OPENING}, text) AS binary)")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("file_path"),
        filefilter.has_binary_signature(content, ScanOptions()).alias("is_binary"),
    )


@register("binary_nul", """
SELECT cast(doc_id AS string) AS file_path, strlen(text) < 8192 AS is_binary FROM documents""")
def binary_nul(spark, sf_dir):
    """A zero byte right after each text."""
    content = F.concat(F.col("text").cast("binary"), F.lit(b"\x00"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("file_path"), filefilter.has_nul(content).alias("is_binary")
    )


@register("size_cap", """
SELECT cast(doc_id AS string) AS file_path, strlen(text) <= 4096 AS is_scanned FROM documents""")
def size_cap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("file_path"),
        filefilter.within_size_cap(F.octet_length("text"), ScanOptions(max_file_bytes=4096)).alias("is_scanned"),
    )


_IGNORE_LINE = "concat('  ', CASE WHEN line LIKE 'Th%' THEN '# ' WHEN line LIKE 'E%' THEN chr(160) ELSE '' END, line, ' ')"


@register("ignore_list", f"""WITH {sql.lines(DOCUMENTS)}
SELECT pattern FROM (
  SELECT regexp_replace({_IGNORE_LINE}, {sql.lit(f"^[{sql.WS}]+|[{sql.WS}]+$")}, '', 'g') AS pattern FROM lines) AS p
WHERE pattern <> '' AND pattern NOT LIKE '#%'""")
def ignore_list(spark, sf_dir):
    """Document lines as an ignore file, some of them made comments."""
    return ignore_patterns(lines.split_lines(documents(spark, sf_dir)).select(F.expr(_IGNORE_LINE).alias("value")))


_LEVEL = "CASE c_mktsegment WHEN 'BUILDING' THEN ' low' WHEN 'MACHINERY' THEN 'Medium ' WHEN 'FURNITURE' THEN 'HIGH' ELSE 'critical' END"


@register("severity_parse", f"""
SELECT c_custkey, upper(trim({_LEVEL})) AS severity,
  CAST(CASE upper(trim({_LEVEL})) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS INTEGER) AS rank
FROM customer""")
def severity_parse(spark, sf_dir):
    named = F.expr(_LEVEL)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", severity_level(named).alias("severity"), severity_rank(named).alias("rank")
    )


@register("decode_utf8", "SELECT cast(doc_id AS string) AS file_path, md5(concat(text, chr(65533), 'b')) AS digest FROM documents")
def decode_utf8(spark, sf_dir):
    """Each text with an invalid byte after it."""
    content = F.concat(F.col("text").cast("binary"), F.lit(b"\xffb"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("file_path"), F.md5(text.decode_utf8(content)).alias("digest")
    )


@register("fold_newlines", """
SELECT cast(doc_id AS string) AS file_path, md5(replace(replace(text, '. ', '.' || chr(10)), ', ', ',' || chr(10))) AS digest
FROM documents""")
def fold_newlines(spark, sf_dir):
    """Texts whose sentences end in a lone CR and whose clauses end in CR LF."""
    mixed = F.replace(F.replace("text", F.lit(". "), F.lit(".\r")), F.lit(", "), F.lit(",\r\n"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("file_path"), F.md5(text.fold_newlines(mixed)).alias("digest")
    )


@register("fingerprint", "SELECT cast(doc_id AS string) AS file_path, sha256(text) AS file_hash FROM documents")
def fingerprint(spark, sf_dir):
    return hashed_documents(spark, sf_dir).select("file_path", "file_hash")


@register("changed_set_scan", sql.scan(
    f"SELECT f.* FROM ({FILES}) AS f JOIN (SELECT concat('src/customer_', cast(c_custkey AS string), '.py') AS file_path "
    "FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')) AS m USING (file_path)"))
def changed_set_scan(spark, sf_dir):
    """Manifest by segment: added, modified, and three states that are not scanned."""
    status = F.translate(F.substring("c_mktsegment", 1, 1), "ABFHM", "AMDRT")
    manifest = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("src/customer_"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("file_path"),
        status.alias("status"),
    )
    wanted = changed_paths(manifest, "/").select(F.expr("substr(file_path, 2)").alias("file_path"))
    return scan_selected(files(spark, sf_dir), wanted).select(*FINDING)


# Files on storage: a tree written from the customer rows into the shared folder, then listed and read.


def _put(batches):
    """Write each text to its path."""
    from pyarrow import fs

    made = set()
    for batch in batches:
        for path, text in zip(batch.column("file_path").to_pylist(), batch.column("text").to_pylist(), strict=True):
            store, inside = fs.FileSystem.from_uri(path)
            parent = inside.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(inside, compression=None) as out:
                out.write(text.encode())
        yield batch.select(["file_path"])


def tree_of(spark: SparkSession, texts: DataFrame) -> str:
    """A new folder with a file for each row (file_path, text)."""
    folder = shared_folder(spark, "tree")
    uri = folder if ":" in folder else f"file://{folder}"
    full = texts.select(F.concat(F.lit(f"{uri}/"), "file_path").alias("file_path"), "text")
    full.mapInArrow(_put, "file_path STRING").write.format("noop").mode("overwrite").save()
    return uri


def inside(found: DataFrame, folder: str) -> DataFrame:
    """Paths as they are below the folder."""
    return found.withColumn("file_path", F.substring_index("file_path", f"/{folder.rsplit('/', 1)[1]}/", -1))


# A third of the files have names or folders that Spark's own listing passes over.
_HIDDEN = "CASE c_custkey % 3 WHEN 0 THEN replace(file_path, 'src/', 'src/.deep/_d/') ELSE file_path END"


def tree_texts(spark, sf_dir):
    keys = F.regexp_extract("file_path", "([0-9]+)", 1).cast("long")
    return files(spark, sf_dir).withColumn("c_custkey", keys).select(F.expr(_HIDDEN).alias("file_path"), "text")


TREE = f"SELECT {_HIDDEN} AS file_path, text FROM (SELECT *, CAST(regexp_extract(file_path, '([0-9]+)', 1) AS BIGINT) AS c_custkey FROM ({FILES}) AS f) AS t"


@register("scan_files_tree", sql.scan(TREE))
def scan_files_tree(spark, sf_dir):
    """A whole tree, with hidden names."""
    folder = tree_of(spark, tree_texts(spark, sf_dir))
    return inside(scan_files(spark, folder), folder).select(*FINDING)


# The kind of a file follows the customer's market segment.
_KIND = "CASE c_mktsegment WHEN 'BUILDING' THEN '.cfg' WHEN 'MACHINERY' THEN '.yaml' ELSE '.py' END"


def segment_texts(spark, sf_dir):
    segments = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    keyed = files(spark, sf_dir).withColumn("c_custkey", F.regexp_extract("file_path", "([0-9]+)", 1).cast("long"))
    return keyed.join(segments, "c_custkey").select(F.expr(f"replace(file_path, '.py', {_KIND})").alias("file_path"), "text", "c_mktsegment")


SEGMENT_FILES = f"""SELECT replace(file_path, '.py', {_KIND}) AS file_path, text, c_mktsegment
FROM ({FILES}) AS f JOIN customer AS c ON CAST(regexp_extract(file_path, '([0-9]+)', 1) AS BIGINT) = c.c_custkey"""


@register("scan_files_glob", sql.scan(f"SELECT file_path, text FROM ({SEGMENT_FILES}) AS t WHERE file_path LIKE '%.cfg'"))
def scan_files_glob(spark, sf_dir):
    """Narrowed to one kind of file."""
    folder = tree_of(spark, segment_texts(spark, sf_dir).drop("c_mktsegment"))
    return inside(scan_files(spark, folder, path_glob="*.cfg", modified_after="2000-01-01"), folder).select(*FINDING)


@register("scan_files_list", sql.scan(TREE))
def scan_files_list(spark, sf_dir):
    """A list of the paths of all files, each with another one that is missing."""
    texts = tree_texts(spark, sf_dir)
    folder = tree_of(spark, texts)
    listed = texts.select(F.explode(F.array("file_path", F.concat("file_path", F.lit(".gone")))).alias("name"))
    paths = listed.select(F.concat(F.lit(f"{folder}/"), "name").alias("path"))
    return inside(scan_files(spark, paths), folder).select(*FINDING)


_SKIPPED_NAME = "concat('f', c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '.PNG' WHEN 'BUILDING' THEN '.txt' WHEN 'FURNITURE' THEN '.log' ELSE '' END)"
_SKIPPED_TEXT = "concat(CASE c_mktsegment WHEN 'BUILDING' THEN 'MZ' WHEN 'MACHINERY' THEN '0123456789012345678901234567890123456789' ELSE '' END, c_name)"


@register("files_skipped", f"""
SELECT file_path, CAST(strlen(text) AS BIGINT) AS length, reason FROM (
  SELECT {_SKIPPED_NAME} AS file_path, {_SKIPPED_TEXT} AS text, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'binary extension'
    WHEN 'BUILDING' THEN 'binary content' WHEN 'FURNITURE' THEN 'ignored' WHEN 'MACHINERY' THEN 'over the size cap' END AS reason
  FROM customer) AS f WHERE reason IS NOT NULL
UNION ALL SELECT 'gone', NULL, 'missing'""")
def files_skipped(spark, sf_dir):
    """Why files are not scanned: a reason for each market segment but one, and a path that is not there."""
    texts = table(spark, sf_dir, "customer").select(F.expr(_SKIPPED_NAME).alias("file_path"), F.expr(_SKIPPED_TEXT).alias("text"))
    folder = tree_of(spark, texts)
    options = ScanOptions(ignore_globs=("*.log",), max_file_bytes=40)
    return inside(skipped_files(spark, [folder, f"{folder}/gone"], options), folder)


@register("files_empty", f"""
SELECT concat('f', c_custkey, {_KIND}) AS file_path, CAST(CASE c_mktsegment WHEN 'FURNITURE' THEN 0 ELSE strlen(c_name) END AS BIGINT) AS length
FROM customer""")
def files_empty(spark, sf_dir):
    """Empty files are text like any others."""
    text = F.expr("CASE c_mktsegment WHEN 'FURNITURE' THEN '' ELSE c_name END").alias("text")
    folder = tree_of(spark, table(spark, sf_dir, "customer").select(F.expr(f"concat('f', c_custkey, {_KIND})").alias("file_path"), text))
    return inside(read_files(spark, folder), folder).select("file_path", "length")


# A name that no file system takes can be asked about, and not read.
_UNREADABLE = "CASE c_mktsegment WHEN 'FURNITURE' THEN concat(repeat('n', 300), c_custkey) ELSE concat('f', c_custkey) END"


@register("files_unreadable", f"""
SELECT md5({_UNREADABLE}) AS digest, c_mktsegment = 'FURNITURE' AS unreadable FROM customer""")
def files_unreadable(spark, sf_dir):
    """Files that can't be read are told with a reason, and the others read all the same."""
    named = table(spark, sf_dir, "customer").select(F.expr(_UNREADABLE).alias("file_path"), F.col("c_name").alias("text"), "c_mktsegment")
    folder = tree_of(spark, named.where("c_mktsegment <> 'FURNITURE'").drop("c_mktsegment"))
    paths = named.select(F.concat(F.lit(f"{folder}/"), "file_path").alias("path"))
    rows = file_rows(spark, paths).where("content IS NOT NULL OR reason LIKE 'unreadable%'")
    return inside(rows, folder).select(F.md5(F.col("file_path").cast("binary")).alias("digest"), F.col("reason").isNotNull().alias("unreadable"))


@register("changed_set_files", sql.scan(
    f"SELECT f.* FROM ({FILES}) AS f JOIN (SELECT concat('src/customer_', cast(c_custkey AS string), '.py') AS file_path "
    "FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')) AS m USING (file_path)"))
def changed_set_files(spark, sf_dir):
    """A tree narrowed by a manifest; files it does not name are not opened."""
    folder = tree_of(spark, files(spark, sf_dir))
    status = F.translate(F.substring("c_mktsegment", 1, 1), "ABFHM", "AMDRT")
    name = F.concat(F.lit("src/customer_"), F.col("c_custkey").cast("string"), F.lit(".py"))
    manifest = table(spark, sf_dir, "customer").select(name.alias("file_path"), status.alias("status"))
    return inside(scan_files(spark, folder, manifest=manifest), folder).select(*FINDING)


@register("incremental_files", sql.scan(
    f"SELECT * FROM ({FILES}) AS f WHERE file_path NOT LIKE '%5.py'",
    "SELECT file_path, line_number, rule_id, description, severity, matched_value, detection_method FROM findings"))
def incremental_files(spark, sf_dir):
    """A tree scanned, then changed and scanned again: findings of untouched files are kept, of deleted ones dropped."""
    texts = files(spark, sf_dir)
    early = texts.select("file_path", F.expr("CASE WHEN file_path LIKE '%1.py' THEN 'changed later' ELSE text END").alias("text"))
    stored_state = state.StateTable(spark, shared_folder(spark, "state"))
    out = shared_folder(spark, "passes")
    folder = tree_of(spark, early)
    first = scan_changed(spark, folder, stored_state, out)
    later = texts.where("file_path LIKE '%1.py'").select(F.concat(F.lit(f"{folder}/"), "file_path").alias("file_path"), "text")
    later.mapInArrow(_put, "file_path STRING").write.format("noop").mode("overwrite").save()
    left = texts.where("file_path NOT LIKE '%5.py'").select(F.concat(F.lit(f"{folder}/"), "file_path").alias("path"))
    second = scan_changed(spark, left, stored_state, out, previous=first.all_findings)
    return inside(second.all_findings, folder)


def _drop(batches):
    """Delete each path."""
    from pyarrow import fs

    for batch in batches:
        for path in batch.column("file_path").to_pylist():
            store, inside = fs.FileSystem.from_uri(path)
            store.delete_file(inside)
        yield batch.select(["file_path"])


@register("incremental_restore", sql.scan(f"SELECT file_path, text FROM ({SEGMENT_FILES}) AS t", """
SELECT p.turn, f.file_path, line_number, rule_id, description, severity, matched_value, detection_method
FROM findings AS f JOIN (SELECT * FROM (VALUES ('whole'), ('removed'), ('touched'), ('restored')) AS v(turn)) AS p
  ON p.turn IN ('whole', 'restored') OR f.file_path NOT LIKE '%.cfg'"""))
def incremental_restore(spark, sf_dir):
    """Passes over a whole tree, without one kind of file, with another kind written anew, and with the first kind back."""
    texts = segment_texts(spark, sf_dir)
    stored_state, out = state.StateTable(spark, shared_folder(spark, "state")), shared_folder(spark, "passes")
    folder = tree_of(spark, texts.drop("c_mktsegment"))
    full = texts.select(F.concat(F.lit(f"{folder}/"), "file_path").alias("file_path"), "text")
    building, machinery = (full.where(F.endswith("file_path", F.lit(kind))) for kind in (".cfg", ".yaml"))
    last, turns = None, []
    for turn, rows, change in (("whole", None, None), ("removed", building, _drop), ("touched", machinery, _put), ("restored", building, _put)):
        if change is not None:
            rows.mapInArrow(change, "file_path STRING").write.format("noop").mode("overwrite").save()
        last = scan_changed(spark, folder, stored_state, out, previous=last).all_findings
        turns.append(inside(last, folder).withColumn("turn", F.lit(turn)))
    return reduce(DataFrame.unionByName, turns)


@register("file_watch", sql.scan(TREE, "SELECT file_path, line_number, rule_id, description, severity, matched_value, detection_method FROM findings"))
def file_watch(spark, sf_dir):
    """A tree with hidden names, watched by a stream: half of it there at the first turn, all at the second."""
    texts = tree_texts(spark, sf_dir)
    hidden = F.contains("file_path", F.lit(".deep"))
    folder = tree_of(spark, texts.where(~hidden))
    stored_state, out = state.StateTable(spark, shared_folder(spark, "state")), work_folder(spark, "watch")
    drain(watch_files(spark, folder, stored_state, f"{out}/passes"), out)
    later = texts.where(hidden).select(F.concat(F.lit(f"{folder}/"), "file_path").alias("file_path"), "text")
    later.mapInArrow(_put, "file_path STRING").write.format("noop").mode("overwrite").save()
    drain(watch_files(spark, folder, stored_state, f"{out}/passes"), out)
    return inside(current_findings(spark, f"{out}/passes", stored_state), folder)


@register("report_findings", sql.scan(FILES, f"SELECT {sql.PUBLIC} FROM findings"))
def report_findings(spark, sf_dir):
    """The findings table of a report, read back."""
    out = shared_folder(spark, "report")
    write_report(file_findings(spark, sf_dir), out)
    return spark.read.schema("file STRING, line INT, rule_id STRING, description STRING, severity STRING, matched_value STRING, detection_method STRING").json(f"{out}/findings")


@register("report_summary", sql.scan(FILES, """
SELECT count(*) AS total, coalesce(bool_or(severity IN ('HIGH', 'CRITICAL')), false) AS should_block,
  max_by(severity, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS max_severity,
  count(DISTINCT file_path) AS files_affected
FROM findings"""))
def report_summary(spark, sf_dir):
    out = shared_folder(spark, "report")
    write_report(file_findings(spark, sf_dir), out)
    summary = "summary STRUCT<total BIGINT, should_block BOOLEAN, max_severity STRING, files_affected BIGINT>"
    return spark.read.schema(summary).json(f"{out}/summary").select("summary.*")


@register("findings_table", sql.scan(FILES, f"SELECT {sql.PUBLIC} FROM findings"))
def findings_table(spark, sf_dir):
    """The findings table, partitioned by severity, read back."""
    out = shared_folder(spark, "findings")
    write_findings(file_findings(spark, sf_dir), out)
    return spark.read.parquet(out)


# State: the stored rows know no Spanish document and hold an older text of the French ones.

STORED = """
stored AS (
  SELECT cast(doc_id AS string) AS file_path, sha256(CASE WHEN lang = 'fr' THEN concat(text, 'old') ELSE text END) AS file_hash,
    TIMESTAMP '2024-01-01 00:00:00' AS last_scanned, n_chars AS findings_count
  FROM documents WHERE lang <> 'es'
),
current_files AS (SELECT cast(doc_id AS string) AS file_path, sha256(text) AS file_hash, lang, n_chars FROM documents)"""
STATE_OUT = "file_path, file_hash, CAST(last_scanned AS VARCHAR) AS last_scanned, findings_count"


def hashed_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("file_path"),
        text.fingerprint(F.col("text").cast("binary")).alias("file_hash"), "lang", "n_chars",
    )


def stored_state(spark, sf_dir):
    old = F.when(F.col("lang") == "fr", F.concat("text", F.lit("old"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where("lang <> 'es'").select(
        F.col("doc_id").cast("string").alias("file_path"), text.fingerprint(old.cast("binary")).alias("file_hash"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_scanned"), F.col("n_chars").alias("findings_count"),
    )


def kept_state(spark, sf_dir):
    """The stored rows in a table of their own."""
    kept = state.StateTable(spark, shared_folder(spark, "state"))
    kept.put(stored_state(spark, sf_dir))
    return kept


def fresh_state(spark, sf_dir):
    return hashed_documents(spark, sf_dir).where("lang IN ('fr', 'es')").select(
        "file_path", "file_hash", F.lit("2024-02-01 00:00:00").cast("timestamp").alias("last_scanned"),
        (F.col("n_chars") + 1).alias("findings_count"),
    )


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("last_scanned", F.col("last_scanned").cast("string"))


FRESH = """
fresh AS (
  SELECT file_path, file_hash, TIMESTAMP '2024-02-01 00:00:00' AS last_scanned, n_chars + 1 AS findings_count
  FROM current_files WHERE lang IN ('fr', 'es')
)"""


@register("has_changed", f"""WITH {STORED}
SELECT c.file_path, s.file_hash IS DISTINCT FROM c.file_hash AS has_changed
FROM current_files AS c LEFT JOIN stored AS s USING (file_path)""")
def has_changed(spark, sf_dir):
    return state.has_changed(hashed_documents(spark, sf_dir), stored_state(spark, sf_dir))


@register("skip_unchanged", f"""WITH {STORED}
SELECT c.file_path, c.file_hash FROM current_files AS c
WHERE NOT EXISTS (SELECT 1 FROM stored AS s WHERE s.file_path = c.file_path AND s.file_hash = c.file_hash)""")
def skip_unchanged(spark, sf_dir):
    return state.changed(hashed_documents(spark, sf_dir), stored_state(spark, sf_dir)).select("file_path", "file_hash")


@register("state_lookup", f"""WITH {STORED}
SELECT c.file_path, s.file_hash FROM current_files AS c LEFT JOIN stored AS s USING (file_path)""")
def state_lookup(spark, sf_dir):
    return state.lookup(hashed_documents(spark, sf_dir), kept_state(spark, sf_dir).current())


@register("state_upsert", f"""WITH {STORED}, {FRESH}
SELECT {STATE_OUT} FROM stored WHERE file_path NOT IN (SELECT file_path FROM fresh)
UNION ALL SELECT {STATE_OUT} FROM fresh""")
def state_upsert(spark, sf_dir):
    kept = kept_state(spark, sf_dir)
    kept.put(fresh_state(spark, sf_dir))
    return shown(kept.current())


@register("state_remove", f"""WITH {STORED}, {FRESH}
SELECT {STATE_OUT} FROM stored WHERE file_path NOT IN (SELECT file_path FROM fresh)""")
def state_remove(spark, sf_dir):
    kept = kept_state(spark, sf_dir)
    kept.remove(fresh_state(spark, sf_dir))
    return shown(kept.current())


@register("state_clear", f"""WITH {STORED}, cleared AS (SELECT * FROM stored WHERE false)
SELECT count(*) AS cached_files, CAST(coalesce(sum(findings_count), 0) AS BIGINT) AS total_findings FROM cleared""")
def state_clear(spark, sf_dir):
    kept = kept_state(spark, sf_dir)
    kept.clear()
    return state.stats(kept.current())


@register("state_stats", f"""WITH {STORED}
SELECT count(*) AS cached_files, CAST(coalesce(sum(findings_count), 0) AS BIGINT) AS total_findings FROM stored""")
def state_stats(spark, sf_dir):
    return state.stats(stored_state(spark, sf_dir))


@register("incremental_scan", sql.scan(
    "SELECT cast(doc_id AS string) AS file_path, text FROM documents WHERE lang IN ('fr', 'es')"))
def incremental_scan(spark, sf_dir):
    """Scan of the documents the state does not hold: those in French and Spanish."""
    again = state.changed(hashed_documents(spark, sf_dir), stored_state(spark, sf_dir))
    return scan_selected(documents(spark, sf_dir), again).select(*FINDING)


@register("carry_forward", sql.scan(DOCUMENTS))
def carry_forward(spark, sf_dir):
    """Stored findings of unchanged documents plus new ones of the rest: the same as a full scan."""
    current = hashed_documents(spark, sf_dir)
    again = state.changed(current, stored_state(spark, sf_dir)).select("file_path")
    source = documents(spark, sf_dir)
    fresh = scan_selected(source, again)
    return state.carry_forward(scan_texts(source), fresh, again).select(*FINDING)


# Streams: the page table as a source, run until it is used up.


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one of the session."""
    return shared_folder(spark, f"leakframe-{name}")


def page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "pages").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/pages*.parquet")


def drain(writer, folder: str) -> None:
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


PUBLIC = sql.PUBLIC


@register("stream_scan", sql.scan(PAGES, f"SELECT {PUBLIC} FROM findings"))
def stream_scan(spark, sf_dir):
    out = work_folder(spark, "scan")
    found = findings.public_findings(scan_stream(page_stream(spark, sf_dir), "page_id", "html"))
    drain(found.writeStream.format("parquet").option("path", f"{out}/findings"), out)
    return spark.read.schema(found.schema).parquet(f"{out}/findings")


@register("stream_gate", sql.scan(PAGES, """
SELECT s.file_path, bool_or(coalesce(f.severity IN ('HIGH', 'CRITICAL'), false)) AS quarantined
FROM src AS s LEFT JOIN findings AS f USING (file_path) GROUP BY s.file_path"""))
def stream_gate_verdicts(spark, sf_dir):
    out = work_folder(spark, "gate")
    drain(stream_gate(page_stream(spark, sf_dir), "page_id", "html", out), out)

    def side(name: str, quarantined: bool) -> DataFrame:
        rows = spark.read.parquet(f"{out}/{name}")
        return rows.select(F.col("page_id").cast("string").alias("file_path"), F.lit(quarantined).alias("quarantined"))

    return side("clean", False).unionByName(side("quarantine", True))


@register("stream_skip_seen", sql.scan(PAGES, """
SELECT s.file_path, sha256(any_value(s.text)) AS file_hash, count(f.rule_id) AS findings_count
FROM src AS s LEFT JOIN findings AS f USING (file_path) GROUP BY s.file_path"""))
def stream_state(spark, sf_dir):
    """State after a stream of pages has passed twice; the second time nothing is new."""
    out = work_folder(spark, "skip")
    stored = state.StateTable(spark, f"{out}/state")
    for turn in ("first", "second"):
        folder = f"{out}/{turn}"
        drain(stream_skip_seen(page_stream(spark, sf_dir), "page_id", "html", folder, stored, name=turn), folder)
    again = spark.read.parquet(f"{out}/second/scanned").count()
    assert again == 0, f"{again} unchanged pages were scanned again"
    return stored.current().select("file_path", "file_hash", "findings_count")
