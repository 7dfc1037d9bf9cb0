"""File filters. Those on the path alone run while files are listed."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakframe.functions.paths import extension, matches_globs
from leakframe.options import NUL_SAMPLE_BYTES, ScanOptions


def has_binary_extension(path: Column, options: ScanOptions) -> Column:
    return extension(path).isin(*options.binary_extensions)


def has_binary_signature(content: Column, options: ScanOptions) -> Column:
    return reduce(or_, [F.startswith(content, F.lit(s)) for s in options.binary_signatures], F.lit(False))


def has_nul(content: Column) -> Column:
    """A zero byte among the first 8,192."""
    return F.contains(F.substring(content, 1, NUL_SAMPLE_BYTES), F.lit(b"\x00"))


def is_binary_content(content: Column, options: ScanOptions) -> Column:
    return has_binary_signature(content, options) | has_nul(content)


def within_size_cap(length: Column, options: ScanOptions) -> Column:
    return F.lit(True) if options.max_file_bytes is None else length <= options.max_file_bytes


def is_ignored(path: Column, relative: Column, options: ScanOptions) -> Column:
    return matches_globs(path, options.ignore_globs, relative)
