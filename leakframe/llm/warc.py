"""WARC archives with a two-level capture index.

Archives hold one gzip member for each record, so a record is read by its byte
range alone. The index is sorted by reversed-host URL keys: lines are cut into
compressed blocks, and the file ends with a sparse directory of the blocks'
first keys. A lookup finds the file among the files' first keys, the block by
binary search in the file's directory, and reads just that block's range.

Files go to the given folder through PyArrow's file systems, each task attempt
under a name of its own; only files named by a finished task's rows are ever
read, so lost executors leave nothing wrong behind.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.llm.scratch import shared_folder, stored

ARCHIVE_BYTES = 1 << 30  # an archive is closed beyond that
BLOCK_LINES = 512  # captures in a compressed block of the index
INDEX_CAPTURES = 1_000_000  # of an index file, or so; their first keys are all a lookup sends to its tasks
TASK_BYTES = 64 << 20  # of records read back by a task, or so
READ_BYTES = 4 << 20  # neighbouring records are read together up to this size
LEAST_REVISIT = 0  # bytes of payload from which equal ones are revisits
CAPTURED = "2024-01-01T00:00:00Z"
_TRAILER = ">QQ"


def url_key(url: str | None) -> str:
    """Host labels in reverse, then port, path and query: ``com,example)/a?b``. Null and broken URLs sort as they are."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    name = ",".join(reversed(host.removeprefix("www.").split(".")))
    shown = "" if port in (None, 80, 443) else f":{port}"
    return f"{name}{shown}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def line_key(url: str | None, page_id: int | None) -> str:
    """What the index is sorted by: the URL's key and the capture's id, so that one URL's captures can lie in many blocks."""
    return f"{url_key(url)} {'' if page_id is None else format(page_id + 2**63, '020d')}".replace("\n", "%0A").replace("\t", "%09")


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit names its response instead of holding a body."""
    revisit = refers_to is not None
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = status if revisit else status + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {CAPTURED}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _write(folder: str, archive_bytes: int):
    """Write archives; a row for each record: (key, file, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = {"key": [], "file": [], "offset": [], "length": []}
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = _record(page_id, url, (html or "").encode(), _base32(digest), refers_to)
                out.write(data)
                for column, value in (("key", line_key(url, page_id)), ("file", name), ("offset", at), ("length", len(data))):
                    rows[column].append(value)
                at += len(data)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    return run


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _index(folder: str, block_lines: int):
    """Write index files from sorted captures; a row for each file: (file, first key, captures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        name, at, count, first = f"{uuid.uuid4().hex}.idx", 0, 0, None
        directory, block, out = [], [], None

        def flush() -> None:
            nonlocal at
            data = gzip.compress("".join(block).encode(), 6, mtime=0)
            out.write(data)
            directory.append([block[0].split("\t", 1)[0], at, len(data)])
            at += len(data)
            block.clear()

        for batch in batches:
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                if out is None:
                    out, first = store.open_output_stream(f"{base}/{name}", compression=None), key
                block.append(f"{key}\t{file}\t{offset}\t{length}\n")
                count += 1
                if len(block) == block_lines:
                    flush()
        if out is not None:
            if block:
                flush()
            listing = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
            out.write(listing)
            out.write(struct.pack(_TRAILER, at, len(listing)))
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first": [first], "captures": [count]}, pa.schema([("file", pa.string()), ("first", pa.string()), ("captures", pa.int64())]))

    return run


class Index:
    """One index file: its directory, and blocks read by range."""

    def __init__(self, folder: str, name: str):
        store, base = _store(folder)
        self.file = store.open_input_file(f"{base}/{name}")
        size = self.file.size()
        at, length = struct.unpack(_TRAILER, self.file.read_at(struct.calcsize(_TRAILER), size - struct.calcsize(_TRAILER)))
        self.blocks = json.loads(gzip.decompress(self.file.read_at(length, at)))
        self.firsts = [b[0] for b in self.blocks]
        self.loaded, self.lines = -1, []

    def block(self, number: int) -> list[list[str]]:
        if number != self.loaded:
            _, at, length = self.blocks[number]
            text = gzip.decompress(self.file.read_at(length, at)).decode()
            self.lines, self.loaded = [line.split("\t") for line in text.split("\n")[:-1]], number
        return self.lines

    def find(self, low: str, high: str) -> Iterator[list[str]]:
        """Captures with ``low`` <= key < ``high``."""
        number = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while number < len(self.blocks) and self.firsts[number] < high:
            lines = self.block(number)
            for line in lines[bisect.bisect_left(lines, [low]) :]:
                if line[0] >= high:
                    return
                yield line
            number += 1


def archive(pages: DataFrame, folder: str, index_captures: int = INDEX_CAPTURES, block_lines: int = BLOCK_LINES, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC archives with an index; returns the index's files (file, first, captures).

    Of equal payloads of at least ``least_revisit`` bytes, rows with the largest
    page id are responses and the others revisits; rows that repeat that id are
    responses each. Null html is an empty payload. A null page id is never the
    largest; where no row of a payload has an id, all are responses. An empty
    table writes no file.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    first = rows.groupBy("digest").agg(F.max("page_id").alias("largest"))
    rows = rows.join(first, "digest")
    same = (F.col("largest").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("largest")) & (F.octet_length("html") >= least_revisit)
    rows = rows.select("page_id", "url", "html", "digest", F.when(same, F.col("largest")).alias("refers_to"))
    captures = stored(rows.mapInArrow(_write(folder, ARCHIVE_BYTES), "key string, file string, offset long, length long"))
    # More files than captures ask for where there are cores to write them: an index of few captures is cheap to open.
    spark = pages.sparkSession
    index_files = max(-(-captures.count() // index_captures), spark.sparkContext.defaultParallelism)
    ordered = captures.repartitionByRange(index_files, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return stored(ordered.mapInArrow(_index(folder, block_lines), "file string, first string, captures long"))


def lookup(pages: DataFrame, folder: str, files: DataFrame, exact: bool = True) -> DataFrame:
    """Captures (key, file, offset, length) of pages (url, and page_id if ``exact``) named by the rows; each once.

    ``files`` is what ``archive`` returned: a row for a million captures or so.
    """
    known = sorted((r["first"], r["file"]) for r in files.select("first", "file").collect())
    firsts = [k for k, _ in known]

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            ids = batch.column("page_id").to_pylist() if exact else [None] * len(urls)
            rows = {"number": [], "low": [], "high": []}
            for url, page_id in zip(urls, ids, strict=True):
                low = line_key(url, page_id)
                high = low + "\x00" if exact else low + "\x7f"
                # Captures of a key may lie in several files.
                for number in range(max(0, bisect.bisect_left(firsts, low) - 1), bisect.bisect_left(firsts, high)):
                    for column, value in (("number", number), ("low", low), ("high", high)):
                        rows[column].append(value)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("number", pa.int32()), ("low", pa.string()), ("high", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, index = -1, None
        for batch in batches:
            rows = []
            for number, low, high in zip(*(batch.column(c).to_pylist() for c in ("number", "low", "high")), strict=True):
                if number != opened:
                    opened, index = number, Index(folder, known[number][1])
                rows.extend(index.find(low, high))
            columns = [*zip(*rows, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array([int(x) for x in columns[2]], pa.int64()), pa.array([int(x) for x in columns[3]], pa.int64())],
                ["key", "file", "offset", "length"],
            )

    wanted = pages.select("url", *(["page_id"] if exact else [])).distinct()
    asked = wanted.mapInArrow(address, "number int, low string, high string").distinct()
    # A look-up reads a block of the index whatever it asks for, so tasks must not be merged by the bytes of the rows.
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartitionByRange(tasks, "number", "low").sortWithinPartitions("number", "low")
    return asked.mapInArrow(search, "key string, file string, offset long, length long")


def read(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures, read by range: page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        opened, file = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out, i = [], 0
            while i < len(rows):
                # Records that follow each other in a file come with one read.
                j, start = i + 1, rows[i]["offset"]
                end = start + rows[i]["length"]
                while j < len(rows) and rows[j]["file"] == rows[i]["file"] and rows[j]["offset"] == end and end - start < READ_BYTES:
                    end += rows[j]["length"]
                    j += 1
                if rows[i]["file"] != opened:
                    opened = rows[i]["file"]
                    file = store.open_input_file(f"{base}/{opened}")
                data = file.read_at(end - start, start)
                for row in rows[i:j]:
                    at = row["offset"] - start
                    out.append(parse(zlib.decompress(data[at : at + row["length"]], 31)))
                i = j
            yield pa.RecordBatch.from_pylist(out, _RECORD)

    # The work is in the records' bytes, which the rows only name. The captures are stored: both jobs see the same.
    captures = stored(captures)
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(-(-size // TASK_BYTES), captures.sparkSession.sparkContext.defaultParallelism)
    ordered = captures.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.select("file", "offset", "length").mapInArrow(fetch, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
])


def parse(record: bytes) -> dict:
    """Fields of one record; a response's payload must have the digest and length it claims."""
    head, rest = record.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda name: int(x) if (x := fields.get(name, "")[12:-1]) else None
    kind, payload = fields["WARC-Type"], None
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if kind == "response":
        payload = block.split(b"\r\n\r\n", 1)[1]
        if len(payload) != size or _base32(hashlib.sha1(payload).hexdigest()) != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": kind, "payload": payload,
        "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To"),
    }


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder, look every page up in the index, and read the records back."""
    folder = shared_folder(pages.sparkSession)
    _make(folder)
    files = archive(pages, folder)
    found = lookup(pages, folder, files)
    return read(found, folder).drop("payload", "url")


def _make(folder: str) -> None:
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
