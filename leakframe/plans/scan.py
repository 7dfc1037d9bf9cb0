"""Scans: a source, the file and line filters, and detection as one lazy plan."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe.functions.text import decode_utf8, fold_newlines
from leakframe.operators.detect import FINDING_COLUMNS, detect
from leakframe.operators.findings import findings_per_file
from leakframe.operators.lines import split_lines
from leakframe.operators.skew import filter_join
from leakframe.operators.state import StateTable, carry_forward
from leakframe.options import ScanOptions
from leakframe.rules import check_patterns
from leakframe.sources.files import file_texts, listing, read_files, read_listed
from leakframe.sources.shared import stored
from leakframe.sources.sinks import write_report
from leakframe.sources.tables import texts_of


def scan_texts(texts: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of (file_path, text) rows, batch or streaming. Custom patterns are checked now, not in a task."""
    check_patterns(texts.sparkSession, [*(r.java_pattern for r in options.custom_rules), *options.ignore_line_patterns])
    return detect(split_lines(texts), options)


def scan_table(table: DataFrame, key: str | Column, text: str | Column, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of a text column; ``key`` labels them. No file filters apply."""
    return scan_texts(texts_of(table, key, text), options)


def scan_files(
    spark: SparkSession, path: str | list[str], options: ScanOptions = ScanOptions(), **listing
) -> DataFrame:
    """Findings of a directory tree, a file, or a list of files.

    Keyword arguments (``manifest``, ``path_glob``, ...) go to ``listing``;
    ``skipped_files`` tells which files were left out and why.
    """
    return scan_texts(file_texts(read_files(spark, path, options, **listing)), options)


def scan_selected(texts: DataFrame, selected: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of the texts whose path is among ``selected``.

    The selection is written first, so it is worked out once and its size is
    known: Spark sends it to the texts where it is small and deals both by path
    where it is not. Either way only selected texts are scanned.
    """
    paths = stored(selected.select("file_path").distinct(), "selection")
    return scan_texts(texts.join(paths, "file_path", "left_semi"), options)


_PASS = "pass-"
FINDINGS_WRITTEN = "file_path STRING, line_number INT, rule_id STRING, description STRING, severity STRING, matched_value STRING, detection_method STRING"

#: Times that are younger than this when a folder is listed don't vouch for a file: it may change again within the same tick.
SETTLED = timedelta(seconds=2)


@dataclass(frozen=True)
class IncrementalScan:
    """Lazy views of one pass.

    ``opened(file_path)`` are the files it read, ``scanned(file_path,
    file_hash)`` those of them whose content was new, ``findings`` theirs
    (public form), ``all_findings`` those of all files that are there.
    """

    opened: DataFrame
    scanned: DataFrame
    findings: DataFrame
    all_findings: DataFrame


def scan_changed(
    spark: SparkSession,
    path: str | list[str] | DataFrame,
    state: StateTable,
    findings_path: str,
    options: ScanOptions = ScanOptions(),
    *,
    previous: DataFrame | None = None,
    track_rules: bool = False,
    **asked,
) -> IncrementalScan:
    """Scan only files whose content is not in the state, then record them.

    A file whose time and length are as recorded is not opened. The others are
    read once: what they hold is hashed and, unless the hash of a file that was
    read in one piece is as recorded, scanned in one go. Findings of other files
    that turn out to be the same are left aside. Results go to a new
    folder of this pass below ``findings_path``, so an earlier pass is never
    overwritten. ``previous`` are the findings of all files after the last pass
    (``all_findings``): they are carried on for files that are there and were
    not scanned again.

    Files that are gone, cannot be read or are not wanted any more leave the
    state with their findings, so that they are reported again once they are
    back. A pass that asks for some files only (``manifest``, ``path_glob``,
    ``modified_after``) leaves what is known of all others as it is. A file
    with a line too long to be scanned is read in every pass. With
    ``track_rules`` a change of rules or options also makes files new.
    """
    rules = options.rule_set_id if track_rules else ""
    name = uuid.uuid4().hex
    folder = f"{findings_path}/{_PASS}{name}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    settled = F.lit(datetime.now(timezone.utc) - SETTLED)
    listed = listing(spark, path, options, **asked)
    known = state.details().select("file_path", *[F.col(c).alias(f"known_{c}") for c in ("file_hash", "modified", "length", "rules", "findings_count", "last_scanned", "batch")])
    as_recorded = (F.col("modified") == F.col("known_modified")) & (F.col("length") == F.col("known_length")) & (F.col("known_rules") == rules)
    wanted = kept(
        listed.where("reason IS NULL").join(known, "file_path", "left")
        .withColumns({"opened": ~F.coalesce(as_recorded, F.lit(False)), "settled": F.when(F.col("modified") < settled, F.col("modified"))}),
        "listed",
    )
    opened = wanted.where("opened")

    read = _read_and_scanned(opened.withColumn("known", F.when(F.col("known_rules") == rules, F.col("known_file_hash"))), options)
    read = kept(read, "read")
    files = kept(_judged(read, opened, rules), "files")
    same, changed, partly = (files.where(F.col("outcome") == x) for x in ("same", "changed", "partly"))
    found = read.where("rule_id IS NOT NULL").drop("note")
    # Written, so that Spark knows how few they are before it deals the findings of all files.
    aside = stored(files.where("outcome IN ('same', 'lost')").select("file_path"), "aside")
    findings = kept(filter_join(found, aside, ["file_path"], "left_anti", ["line_number", "rule_id"]), "findings")
    untouched = wanted.where("NOT opened").select("file_path")
    live = untouched.unionByName(files.where("outcome <> 'lost'").select("file_path"))
    if previous is None:
        everything = findings
    else:
        present = live
        if asked:
            # What this pass did not ask for is still there as far as it can tell.
            others = previous.select("file_path").distinct().join(listed.select("file_path"), "file_path", "left_anti")
            present = live.unionByName(others)
        everything = kept(carry_forward(previous, findings, changed.unionByName(partly), present), "all_findings")

    scanned = findings_per_file(changed, findings, keep=("file_hash", "settled", "length")).withColumns({"last_scanned": F.current_timestamp(), "batch": F.lit(name)})
    checked = same.select("file_path", "file_hash", "settled", "length", F.col("known_findings_count").alias("findings_count"), F.col("known_last_scanned").alias("last_scanned"), F.col("known_batch").alias("batch"))
    rows = scanned.unionByName(checked).withColumnRenamed("settled", "modified").withColumn("rules", F.lit(rules))
    recorded = untouched.unionByName(files.where("outcome IN ('same', 'changed')").select("file_path"))
    gone = state.details().select("file_path").join(recorded, "file_path", "left_anti")
    state.put(rows, gone=gone.join(listed.select("file_path"), "file_path", "left_semi") if asked else gone)
    return IncrementalScan(opened.select("file_path"), changed.select("file_path", "file_hash"), findings, everything)


def current_findings(spark: SparkSession, findings_path: str, state: StateTable) -> DataFrame:
    """Findings of all content that the state holds, out of the passes below ``findings_path``.

    A file's findings are those of the pass that scanned what it holds now, so a
    pass that was repeated counts once. Files with a line too long to be scanned
    are not in the state.
    """
    written = spark.read.schema(f"{FINDINGS_WRITTEN}").option("basePath", findings_path).option("pathGlobFilter", "part-*")
    found = written.parquet(f"{findings_path}/{_PASS}*/findings").withColumn("batch", F.regexp_extract(F.input_file_name(), f"/{_PASS}([0-9a-f]+)/", 1))
    held = state.details().select("file_path", "batch")
    return found.join(held, ["file_path", "batch"], "left_semi").drop("batch")


def scan_configured(spark: SparkSession, path: str | list[str] | DataFrame, options: ScanOptions, **asked) -> DataFrame:
    """Findings of all files there, in their public form, the way ``options`` ask for it.

    Switched off there are none. With a state (``cache_path``) only changed files
    are scanned and the findings of the others come from earlier passes, which
    are kept beside it; a change of rules or options counts as one. A report is
    written where ``report_path`` says.
    """
    if not options.enabled:
        return spark.createDataFrame([], FINDINGS_WRITTEN)
    if options.cache_enabled and options.cache_path:
        state, out = StateTable(spark, f"{options.cache_path}/state"), f"{options.cache_path}/passes"
        scan_changed(spark, path, state, out, options, track_rules=True, **asked)
        found = current_findings(spark, out, state)
    else:
        found = scan_files(spark, path, options, **asked).select(*[c for c in FINDING_COLUMNS if c != "raw_value"])
    if options.report_path:
        write_report(found, options.report_path, options.block_level)
    return found


def _read_and_scanned(opened: DataFrame, options: ScanOptions) -> DataFrame:
    """Findings of files in their public form, and for each byte range read one row without a rule and with a ``note`` on it."""
    told = F.when(F.col("content").isNull(), F.to_json(F.struct("begin", "hash", "problem"))).alias("note")
    text = F.coalesce(fold_newlines(decode_utf8(F.col("content"))), F.lit("")).alias("text")
    pieces = read_listed(opened, options, hashed=True).select("file_path", "first_line", text, told)
    rows = detect(split_lines(pieces, carry=("note",)), options, note="note")
    note = F.when(F.col("rule_id").isNull(), F.col("raw_value")).alias("note")
    return rows.select(*[c for c in FINDING_COLUMNS if c != "raw_value"], note)


def _judged(read: DataFrame, opened: DataFrame, rules: str) -> DataFrame:
    """Opened files with their ``file_hash`` and ``outcome``.

    ``same`` as recorded or ``changed``; ``partly`` scanned for a line that is
    too long, ``lost`` if unreadable or binary. The hash of a file that was read
    in several ranges is that of its ranges' hashes.
    """
    note = F.from_json("note", "begin LONG, hash STRING, problem STRING")
    notes = read.where("rule_id IS NULL").select("file_path", note.alias("of")).select("file_path", "of.*")
    problem = F.col("problem")
    files = notes.groupBy("file_path").agg(
        F.count_if(problem.isNotNull() & ~problem.startswith("line ")).alias("lost"), F.count("problem").alias("problems"),
        F.array_sort(F.collect_list(F.struct("begin", "hash"))).alias("ranges"),
    )
    whole = F.sha2(F.array_join(F.col("ranges.hash"), ""), 256)
    file_hash = F.when(F.size("ranges") == 1, F.get(F.col("ranges.hash"), F.lit(0))).otherwise(whole)
    joined = files.withColumn("file_hash", file_hash).drop("ranges").join(opened.drop("path", "reason", "opened"), "file_path")
    as_known = F.coalesce((F.col("file_hash") == F.col("known_file_hash")) & (F.col("known_rules") == rules), F.lit(False))
    outcome = F.when(F.col("lost") > 0, "lost").when(F.col("problems") > 0, "partly").when(as_known, "same").otherwise("changed")
    return joined.withColumn("outcome", outcome).drop("lost", "problems")
