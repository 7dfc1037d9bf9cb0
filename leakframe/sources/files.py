"""Files as scan input: whole trees, explicit paths, changed sets, ignore lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakframe.functions.paths import basename, below, glob_to_regex, normalise
from leakframe.functions.text import WHITESPACE, decode_utf8, fold_newlines
from leakframe.operators.filefilter import has_binary_extension, is_binary_content, is_ignored, within_size_cap
from leakframe.options import ScanOptions
from leakframe.sources import walk
from leakframe.sources.shared import stored

# States of a changed file that is still there to be scanned.
CHANGED_STATUSES = ("A", "C", "M")


# Files of about this many bytes are read by one task; longer ones by several, a range of so many bytes each.
TASK_BYTES = 128 * 1024 * 1024
RANGE_BYTES = 128 * 1024 * 1024
OPEN_BYTES = 64 * 1024
FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def list_files(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """(path, length, modified, problem) of all files below the paths, hidden and empty ones included.

    ``path`` is a directory, a file, a list of them, or a table with a column
    ``path``. Tasks list the folders, one level at a time, so neither a large
    tree nor a long list passes through the driver. What cannot be listed, links
    to folders and version control are rows with a ``problem``.
    """
    if not isinstance(path, DataFrame):
        path = spark.createDataFrame([(p,) for p in ([path] if isinstance(path, str) else path)], "path STRING")
    levels = [stored(path.select("path").distinct().mapInArrow(walk.stat_paths, walk.ENTRIES), "listing")]
    tasks = 4 * spark.sparkContext.defaultParallelism
    steps = {"folder": walk.list_folders, "name": walk.stat_paths}
    while kinds := levels[-1].where(F.col("kind").isin(*steps)).groupBy("kind").count().collect():
        of = lambda k: levels[-1].where(F.col("kind") == k.kind).select("path").repartition(min(tasks, k["count"]), "path")
        levels.append(stored(reduce(DataFrame.unionByName, [of(k).mapInArrow(steps[k.kind], walk.ENTRIES) for k in kinds]), "listing"))
    found = reduce(DataFrame.unionByName, levels).where("kind NOT IN ('folder', 'name')").drop("kind")
    return found.dropDuplicates(["path"])


def listing(
    spark: SparkSession,
    path: str | list[str] | DataFrame,
    options: ScanOptions = ScanOptions(),
    *,
    manifest: DataFrame | None = None,
    path_glob: str | None = None,
    modified_after: str | None = None,
) -> DataFrame:
    """(path, file_path, length, modified, reason) of every file asked for; nothing is opened.

    ``reason`` says why a file is not scanned and is null for those that are to
    be read. ``manifest(file_path, status)`` asks for added, copied and modified
    paths only, ``path_glob`` for base names, ``modified_after`` for later
    files. What is asked for and not there, or cannot be listed, has a reason.
    """
    root = path.removeprefix("file://").removeprefix("file:") if isinstance(path, str) else "/"
    listed = list_files(spark, path).withColumn("file_path", normalise(F.col("path")))
    lost = F.col("problem").isNotNull()
    if path_glob is not None:
        listed = listed.where(F.rlike(basename(F.col("file_path")), F.lit(glob_to_regex(path_glob))) | lost)
    if modified_after is not None:
        listed = listed.where((F.col("modified") > F.lit(modified_after).cast("timestamp")) | lost)
    if manifest is not None:
        listed = listed.join(changed_paths(manifest, root).withColumn("named", F.lit(True)), "file_path", "full")
        missing = F.when(F.col("path").isNull(), F.lit("missing")).otherwise(F.col("problem"))
        listed = listed.where(F.col("named") | lost).withColumn("problem", missing)
    return stored(listed.select("path", "file_path", "length", "modified", _reason(options, root).alias("reason")), "files")


def _signatures(options: ScanOptions) -> tuple[bytes, ...] | None:
    return options.binary_signatures if options.skip_binary else None


def _dealt(wanted: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a listing over as many tasks as their bytes need, opening a file counted as ``OPEN_BYTES``."""
    size = wanted.agg(F.coalesce(F.sum(F.coalesce("length", F.lit(0)) + OPEN_BYTES), F.lit(0))).first()[0]
    few = min(4 * wanted.sparkSession.sparkContext.defaultParallelism, -(-size // (16 * OPEN_BYTES)))
    return wanted.repartition(max(few, -(-size // TASK_BYTES), 1), *by)


def byte_ranges(wanted: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """(path, begin, stop, first_line) of the ranges that listed files are read in, one for most files.

    Of files in several ranges the line ends are counted first, range by range;
    their sums before each range are its line numbers. A column ``known`` goes along.
    """
    carried = [c for c in ("known",) if c in wanted.columns]
    length = F.coalesce("length", F.lit(0)).cast("long")
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(length - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long"))
    spans = wanted.select("path", *carried, length.alias("length"), F.explode(begins).alias("begin"))
    stop = F.when(F.col("begin") + RANGE_BYTES < F.col("length"), F.col("begin") + RANGE_BYTES).alias("stop")
    spans = spans.select("path", *carried, "length", "begin", stop, F.lit(1).cast("long").alias("first_line"))
    long = spans.where(F.col("length") > RANGE_BYTES)
    if long.isEmpty():
        return spans
    asked = _dealt(long.withColumn("length", F.lit(RANGE_BYTES)), ["path", "begin"]).select("path", "begin", "stop", "first_line")
    counts = stored(asked.mapInArrow(walk.read_ranges(_signatures(options), contents=False), walk.PIECES), "lines")
    earlier = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    numbers = counts.select("path", "begin", (1 + F.coalesce(F.sum("lines").over(earlier), F.lit(0))).alias("first_line"))
    return spans.where(F.col("length") <= RANGE_BYTES).unionByName(long.drop("first_line").join(numbers, ["path", "begin"]))


def read_listed(listed: DataFrame, options: ScanOptions = ScanOptions(), hashed: bool = False) -> DataFrame:
    """What is in listed files without a reason: (file_path, begin, first_line, content, lines, hash, problem).

    Rows with content are pieces of whole lines, from ``first_line`` on; a file
    of few megabytes is one. After them, each byte range has one row without
    content that tells its hash and whatever went wrong. Contents cross no
    shuffle, and of binary files only the first bytes are read. With ``hashed``,
    a file of one piece whose hash is in a column ``known`` has that last row alone.
    """
    ranges = byte_ranges(listed.where("reason IS NULL"), options)
    asked = [c for c in ("path", "begin", "stop", "first_line", "known") if c in ranges.columns]
    dealt = _dealt(ranges.withColumn("length", F.least("length", F.lit(RANGE_BYTES))), ["path", "begin"]).select(*asked)
    read = dealt.mapInArrow(walk.read_ranges(_signatures(options), hashed=hashed), walk.PIECES)
    return read.withColumn("file_path", normalise(F.col("path"))).drop("path")


def file_rows(spark: SparkSession, path: str | list[str] | DataFrame, options: ScanOptions = ScanOptions(), **asked) -> DataFrame:
    """(file_path, length, first_line, content, reason): pieces of files that are scanned, and a row for each that is not.

    Arguments as for ``listing``. Every filter that needs no content works on
    the listing; only files that pass are opened. A file of which a line is too
    long to be scanned has pieces and a reason.
    """
    listed = listing(spark, path, options, **asked)
    read = read_listed(listed, options).where("content IS NOT NULL OR problem LIKE 'line %' OR problem IS NOT NULL AND begin = 0")
    kept = read.select("file_path", F.octet_length("content").cast("long").alias("length"), "first_line", "content", F.col("problem").alias("reason"))
    rest = listed.where("reason IS NOT NULL").select("file_path", "length", F.lit(1).cast("long").alias("first_line"), F.lit(None).cast("binary").alias("content"), "reason")
    return kept.unionByName(rest)


def _reason(options: ScanOptions, root: str) -> Column:
    path = F.col("file_path")
    reason = F.when(F.col("problem").isNotNull(), F.col("problem"))
    if options.max_file_bytes is not None:
        reason = reason.when(~within_size_cap(F.col("length"), options), "over the size cap")
    if options.skip_binary:
        reason = reason.when(has_binary_extension(path, options), "binary extension")
    if options.ignore_globs:
        reason = reason.when(is_ignored(path, below(path, root), options), "ignored")
    return reason


def read_files(spark: SparkSession, path: str | list[str] | DataFrame, options: ScanOptions = ScanOptions(), **asked) -> DataFrame:
    """Text files to scan as (file_path, length, first_line, content); long ones in several pieces. Arguments as for ``listing``."""
    return file_rows(spark, path, options, **asked).where("content IS NOT NULL").drop("reason")


def skipped_files(spark: SparkSession, path: str | list[str] | DataFrame, options: ScanOptions = ScanOptions(), **asked) -> DataFrame:
    """(file_path, length, reason) of files that are not scanned, or not all of them; unreadable and missing ones among them.

    Of a file that could hold no line too long to be scanned only the first bytes are read.
    """
    listed = listing(spark, path, options, **asked)
    wanted, name = listed.where("reason IS NULL"), normalise(F.col("path")).alias("file_path")
    short = _dealt(wanted.where(F.col("length") <= walk.LINE_BYTES).withColumn("length", F.lit(0)), ["path"])
    tested = short.select("path").mapInArrow(walk.head_tests(_signatures(options)), "path STRING, problem STRING").select(name, "problem")
    long = byte_ranges(wanted.where(F.col("length") > walk.LINE_BYTES), options).select("path", "begin", "stop", "first_line")
    read = long.mapInArrow(walk.read_ranges(_signatures(options), contents=False), walk.PIECES)
    tested = tested.unionByName(read.where("problem LIKE 'line %' OR begin = 0").select(name, "problem")).where("problem IS NOT NULL")
    found = tested.join(wanted.select("file_path", "length"), "file_path").select("file_path", "length", F.col("problem").alias("reason"))
    return listed.where("reason IS NOT NULL").select("file_path", "length", "reason").unionByName(found)


def read_file_stream(spark: SparkSession, path: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Text files arriving below a directory, as a stream; names with a leading ``.`` or ``_`` are not seen."""
    arriving = (
        spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true").load(path)
    )
    files = arriving.select(normalise(F.col("path")).alias("file_path"), "length", "content", F.lit(None).cast("string").alias("problem"))
    files = files.where(_reason(options, path).isNull()).drop("problem")
    return files.where(~is_binary_content(F.col("content"), options)) if options.skip_binary else files


def changed_paths(manifest: DataFrame, root: str = "/") -> DataFrame:
    """Distinct normalised paths of a manifest whose status means there is new content."""
    return (
        manifest.where(F.col("status").isin(*CHANGED_STATUSES))
        .select(normalise(F.col("file_path"), root).alias("file_path"))
        .distinct()
    )


def file_texts(files: DataFrame) -> DataFrame:
    """(file_path, text), and ``first_line`` where files have it: decoded, with newlines folded."""
    numbered = ["first_line"] if "first_line" in files.columns else []
    return files.select("file_path", *numbered, fold_newlines(decode_utf8(F.col("content"))).alias("text"))


def ignore_patterns(lines: DataFrame) -> DataFrame:
    """Patterns among the lines (value) of an ignore file: no blank lines, no ``#`` comments."""
    trimmed = F.regexp_replace("value", f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")
    return lines.select(trimmed.alias("pattern")).where(
        (F.col("pattern") != "") & ~F.startswith(F.col("pattern"), F.lit("#"))
    )


def ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of an ignore file, one per line."""
    return ignore_patterns(spark.read.text(path))


def load_ignore_globs(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The ignore file as an option value."""
    return tuple(row.pattern for row in ignore_list(spark, path).collect())
