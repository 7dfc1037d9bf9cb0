"""Listing and reading of files inside tasks, through PyArrow's file systems.

Spark's own listing passes over names with a leading ``.`` or ``_`` and over
empty files, which in a source tree are ``.env`` and ``__init__.py``. These
functions see every file, and tell what they could not list or read. Contents
are read by byte ranges, as pieces of whole lines, so no task holds a whole file.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

# Tasks rebuild these functions from their code, so the package need not be on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Version-control storage holds no files of the tree.
SKIPPED_FOLDERS = (".git",)
PAGE = 10_000  # entries of a folder listed at a time
HEAD_BYTES = 8192  # what is read of a file to tell whether it is binary
PIECE_BYTES = 8 * 1024 * 1024  # read of a file at a time
LINE_BYTES = 64 * 1024 * 1024  # a longer line is not scanned, which is told
BATCH_BYTES = 32 * 1024 * 1024  # of pieces handed on together

ENTRIES = "path STRING, kind STRING, length BIGINT, modified TIMESTAMP, problem STRING"
RANGES = "path STRING, begin BIGINT, stop BIGINT, first_line BIGINT"
PIECES = "path STRING, begin BIGINT, first_line BIGINT, content BINARY, lines BIGINT, hash STRING, problem STRING"

# A line ends with a line feed, or with a carriage return that none follows.
_LINE_END = re.compile(rb"\n|\r(?!\n)")


def filesystem(path: str):
    """PyArrow file system of a path, the path in it, and what precedes that path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if not re.match(r"[A-Za-z][A-Za-z0-9+.\-]+:", path):
        return fs.LocalFileSystem(), path.rstrip("/") or "/", ""
    try:
        found, inside = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path.rstrip("/")))
    except (ValueError, NotImplementedError) as error:
        raise ValueError(f"no file system for {path}") from error
    return found, inside, path.rstrip("/").removesuffix(inside)


def _entry(path: str, kind: str, info=None, problem: str | None = None) -> tuple:
    return path, kind, info.size if info else None, info.mtime if info else None, problem


def _kind(info, prefix: str) -> tuple:
    from pyarrow import fs

    if info.type == fs.FileType.File:
        return _entry(prefix + info.path, "file", info)
    if info.type == fs.FileType.Directory:
        return _entry(prefix + info.path, "folder")
    return _entry(prefix + info.path, "lost", problem="missing" if info.type == fs.FileType.NotFound else "not a file")


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
    names = [part.split(" ")[0] for part in ENTRIES.split(", ")]
    columns = zip(*entries, strict=True) if entries else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def stat_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each path is. Local ones are asked about in one call, one by one only where that fails."""
    from pyarrow import fs

    for batch in batches:
        out, asked = [], [(path, *filesystem(path)) for path in batch.column("path").to_pylist()]
        local = [a for a in asked if isinstance(a[1], fs.LocalFileSystem)]
        try:
            infos = fs.LocalFileSystem().get_file_info([inside for _, _, inside, _ in local])
            out += [_kind(info, prefix) for info, (_, _, _, prefix) in zip(infos, local, strict=True)]
            asked = [a for a in asked if not isinstance(a[1], fs.LocalFileSystem)]
        except OSError:
            pass
        for path, found, inside, prefix in asked:
            try:
                out.append(_kind(found.get_file_info(inside), prefix))
            except OSError as error:
                out.append(_entry(path, "lost", problem=f"unreadable: {error}"))
        yield _batch(out)


def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each folder holds, one level down.

    Links to folders are not followed and version control is left out; both are
    told. Of a local folder with more than a page of entries only names are
    listed here, of kind ``name``: what they are is asked by other tasks.
    """
    from pyarrow import fs

    for batch in batches:
        for path in batch.column("path").to_pylist():
            found, inside, prefix = filesystem(path)
            try:
                if isinstance(found, fs.LocalFileSystem):
                    yield from _local_pages(inside, prefix)
                    continue
                children = found.get_file_info(fs.FileSelector(inside))
            except OSError as error:
                yield _batch([_entry(path, "lost", problem=f"unreadable: {error}")])
                continue
            for start in range(0, len(children), PAGE):
                yield _batch([_left_out(c.base_name, prefix + c.path) or _kind(c, prefix) for c in children[start : start + PAGE]])


def _left_out(name: str, path: str) -> tuple | None:
    return _entry(path, "lost", problem="version control") if name in SKIPPED_FOLDERS else None


def _local_pages(folder: str, prefix: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    local, page, full = fs.LocalFileSystem(), [], False

    def told(entries: list) -> pa.RecordBatch:
        out, plain = [], []
        for e in entries:
            left_out = _left_out(e.name, prefix + e.path)
            if left_out:
                out.append(left_out)
            elif e.is_symlink() and e.is_dir():
                out.append(_entry(prefix + e.path, "lost", problem="link to a folder"))
            elif full:
                out.append(_entry(prefix + e.path, "name"))
            else:
                plain.append(e.path)
        return _batch(out + [_kind(info, prefix) for info in local.get_file_info(plain)])

    with os.scandir(folder) as entries:
        for entry in entries:
            page.append(entry)
            if len(page) == PAGE:
                yield told(page)
                page, full = [], True
    if page:
        yield told(page)


def _binary(head: bytes, signatures: tuple[bytes, ...] | None) -> str | None:
    return "binary content" if signatures is not None and (head.startswith(signatures) or b"\0" in head) else None


def head_tests(signatures: tuple[bytes, ...] | None):
    """(path, problem) of files, by their first bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problems = []
            for path in batch.column("path").to_pylist():
                found, inside, _ = filesystem(path)
                try:
                    with found.open_input_file(inside) as file:
                        problems.append(_binary(file.read(HEAD_BYTES), signatures))
                except OSError as error:
                    problems.append(f"unreadable: {error}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(problems, pa.string())], ["path", "problem"])

    return run


def lines_in_range(file, begin: int, stop: int | None) -> Iterator[tuple[bytes | None, int]]:
    """(bytes, line ends in them) of the lines that begin in a byte range, in pieces of whole lines.

    A range without ``stop`` goes to the end of the file. A line of more than
    ``LINE_BYTES`` comes as ``None`` in its place. Ranges that follow one
    another share no line and leave none out.
    """
    base, held = max(begin - 1, 0), b""  # ``held`` was read from ``base`` on and is not handed on yet
    file.seek(base)
    skipping, too_long, nothing = begin > 0, False, begin == 0
    while True:
        read = file.read(PIECE_BYTES)
        # Whether a carriage return ends a line shows in the byte after it.
        while read.endswith(b"\r") and (after := file.read(1)):
            read += after
        held += read
        if skipping:  # to the end of a line of an earlier range, or of one that is too long
            found = _LINE_END.search(held)
            passed = found.end() if found else len(held)
            base, held = base + passed, held[passed:]
            over = stop is not None and base >= stop
            if too_long and (found or over or not read):
                yield None, 1
                too_long = False
            if over or not found and not read:
                return
            if not found:
                continue
            skipping = False
        if stop is not None and base + len(held) >= stop and (found := _LINE_END.search(held, stop - 1 - base)):
            yield _counted(held[: found.end()])
            return
        if not read:
            if held or nothing:
                yield _counted(held)
            return
        if len(held) < PIECE_BYTES:
            continue
        cut = held.rfind(b"\n") + 1
        if cut <= (alone := held.rfind(b"\r", 0, len(held) - 1)):
            cut = alone + 1
        if cut:
            yield _counted(held[:cut])
            base, held, nothing = base + cut, held[cut:], False
        elif len(held) > LINE_BYTES:
            base, held, nothing = base + len(held), b"", False
            skipping = too_long = True


def _counted(content: bytes) -> tuple[bytes, int]:
    return content, content.count(b"\n") + content.count(b"\r") - content.count(b"\r\n")


def _rows(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string())
    names = [part.split(" ")[0] for part in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_ranges(signatures: tuple[bytes, ...] | None, contents: bool = True, hashed: bool = False):
    """Byte ranges of files as pieces of whole lines, and after each range's pieces one row without content.

    That row tells how many line ends the range holds, the hash of its lines,
    and why it, or a line of it, could not be read. The first bytes are read
    first: of a binary file nothing more. Where ranges have a ``known`` hash, the
    content of a file in one piece with that hash is not handed on.
    """

    def of_range(path: str, begin: int, stop: int | None, first_line: int, known: str | None = None) -> Iterator[tuple]:
        lines, digest, problem = 0, hashlib.sha256(), None
        waiting, pieces = None, 0  # the last piece waits until it is clear whether it is all and known
        try:
            found, inside, _ = filesystem(path)
            with found.open_input_file(inside) as file:
                problem = _binary(file.read(HEAD_BYTES), signatures)
                if problem is None:
                    file.seek(begin)
                    for content, ends in lines_in_range(file, begin, stop):
                        if content is None:
                            problem = f"line {first_line + lines} is over {LINE_BYTES} bytes"
                        elif contents:
                            if waiting:
                                yield waiting
                            waiting, pieces = (path, begin, first_line + lines, content, None, None, None), pieces + 1
                        if hashed and content is not None:
                            digest.update(content)
                        lines += ends
        except OSError as error:
            problem = f"unreadable: {error}"
        whole = hashed and problem is None and pieces == 1 and begin == 0 and stop is None
        if waiting and not (whole and digest.hexdigest() == known):
            yield waiting
        yield path, begin, first_line, None, lines, digest.hexdigest(), problem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            given = [c for c in ("path", "begin", "stop", "first_line", "known") if c in batch.schema.names]
            for asked in zip(*(batch.column(c).to_pylist() for c in given), strict=True):
                for row in of_range(*asked):
                    rows.append(row)
                    size += len(row[3] or b"")
                    if size >= BATCH_BYTES:
                        yield _rows([*zip(*rows, strict=True)])
                        rows, size = [], 0
            if rows:
                yield _rows([*zip(*rows, strict=True)])

    return run
