"""File source, file filters, incremental scans and sinks on a directory written here."""

import hashlib
import io
import json
import os
import re
import time
from datetime import datetime

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from leakframe import ScanOptions, StateTable, scan_changed, scan_configured, scan_files, write_findings, write_report
from leakframe.functions import paths, text
from leakframe.operators import findings as roll
from leakframe.operators import state
from leakframe.sources import files, walk
from leakframe.sources.files import file_rows, file_texts, ignore_list, load_ignore_globs, read_files, skipped_files

KEY = "AKIA" + "IOSFODNN7EXAMPL2"
LEAK = f"id = {KEY}\n".encode()


def put(root, files):
    for name, content in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)


def names(frame, root):
    return sorted(r.file_path.removeprefix(f"{root}/") for r in frame.select("file_path").collect())


def texts(spark, root, *args, **kwargs):
    frame = file_texts(read_files(spark, str(root), *args, **kwargs))
    return {r.file_path.removeprefix(f"{root}/"): r.text for r in frame.collect()}


def test_binary_files(spark, tmp_path):
    put(tmp_path, {
        "a.png": LEAK, "b/tool.EXE": LEAK, "code.py": LEAK, "nul": b"hello\0world", "magic.data": b"\x89PNG\r\n",
        "mz.txt": b"MZ text", "late.txt": b"x" * 8192 + b"\0", "edge.txt": b"x" * 8191 + b"\0", "empty": b"",
        ".env": LEAK, "x.tar.gz": LEAK, ".x.db": LEAK, "we ird+%41#é.py": LEAK, "we ird.png": LEAK,
    })
    assert names(read_files(spark, str(tmp_path)), tmp_path) == sorted(
        ["code.py", "late.txt", "empty", ".env", "we ird+%41#é.py"]
    )
    everything = ScanOptions(skip_binary=False)
    assert len(names(read_files(spark, str(tmp_path), everything), tmp_path)) == 14


def test_hidden_names(spark, tmp_path):
    """Names Spark's listing passes over are scanned too, and none twice."""
    tree = [
        ".env", "_a.py", "__init__.py", "plain.py", ".github/w.yml", "_d/x.py", "d/.e/f/g.py", "d/_k=v.py", "_k=v/p.py",
        "_metadata", "_metadata.py", "d/_common_metadata", "x._COPYING_", "k=1/y.py", "..odd", "_p=1/_q/z.py",
    ]
    put(tmp_path, {n: LEAK for n in tree} | {".git/objects/o": LEAK, "d/none": b"", ".hidden.png": LEAK})
    assert names(read_files(spark, str(tmp_path)), tmp_path) == sorted([*tree, "d/none"])
    assert names(scan_files(spark, f"file://{tmp_path}"), tmp_path) == sorted(tree)
    assert names(scan_files(spark, [str(tmp_path / n) for n in tree[:4]]), tmp_path) == sorted(tree[:4])


def test_roots():
    from leakframe.sources.walk import filesystem

    assert [filesystem(r)[1:] for r in ("/a/b/", "file:/a", "file:///a b", "rel")] == [("/a/b", ""), ("/a", ""), ("/a b", ""), ("rel", "")]
    with pytest.raises(ValueError, match="no file system"):
        filesystem("nosuch://host/a")


def test_dropped_files_are_not_opened(spark, tmp_path):
    """Filters work on the listing: a binary or ignored file that can't be read does no harm, a wanted one is told of."""
    put(tmp_path, {"ok.py": LEAK, "lost.py": LEAK, "big.png": b"x" * 4000, "vendor/lib.py": LEAK, "other.py": LEAK})
    manifest = spark.createDataFrame([(n, "M") for n in ("ok.py", "lost.py", "big.png", "vendor/lib.py")], "file_path STRING, status STRING")
    frame = file_rows(spark, str(tmp_path), ScanOptions(ignore_globs=("vendor/",)), manifest=manifest)
    for name in ("lost.py", "big.png", "vendor/lib.py", "other.py"):
        (tmp_path / name).unlink()
    reasons = {r.file_path.removeprefix(f"{tmp_path}/"): r.reason for r in frame.collect()}
    assert reasons.pop("lost.py").startswith("unreadable")
    assert reasons == {"ok.py": None, "big.png": "binary extension", "vendor/lib.py": "ignored"}


def test_glob_and_time_reach_all_files(spark, tmp_path):
    put(tmp_path, {n: LEAK for n in ("a.py", "pkg/__init__.py", ".env", ".d/x.py", "b.txt")})
    assert names(read_files(spark, str(tmp_path), path_glob="*.py"), tmp_path) == [".d/x.py", "a.py", "pkg/__init__.py"]
    assert len(names(read_files(spark, str(tmp_path), modified_after="2000-01-01"), tmp_path)) == 5
    assert names(read_files(spark, str(tmp_path), modified_after="2100-01-01"), tmp_path) == []


def test_contents_cross_no_shuffle(spark, tmp_path):
    put(tmp_path, {"a.py": LEAK})
    manifest = spark.createDataFrame([("a.py", "M")], "file_path STRING, status STRING")
    tree = file_rows(spark, str(tmp_path), manifest=manifest)._jdf.queryExecution().executedPlan().toString()
    reading = tree.index("MapInArrow")
    assert "Exchange" not in tree[:reading] and "Join" not in tree[:reading]


def plain_lines(data):
    """(offset, bytes) of the lines of a file, and how many line ends each has."""
    out, at = [], 0
    for line in re.split(rb"(?<=\n)|(?<=\r)(?!\n)", data):
        if line:
            out.append((at, line))
            at += len(line)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bb", b"\n", b"\r", b"\r\n", "é".encode()]), max_size=40).map(b"".join), st.integers(1, 9), st.integers(1, 7), st.integers(3, 50))
def test_ranges_hold_every_line_once(data, step, piece, longest):
    old = walk.PIECE_BYTES, walk.LINE_BYTES
    walk.PIECE_BYTES, walk.LINE_BYTES = piece, longest
    try:
        lines = plain_lines(data)
        for begin in range(0, max(len(data), 1), step):
            stop = begin + step if begin + step < len(data) else None
            got = [*walk.lines_in_range(io.BytesIO(data), begin, stop)]
            mine = [line for at, line in lines if at >= begin and (stop is None or at < stop)]
            if all(content is not None for content, _ in got):
                assert b"".join(content for content, _ in got) == b"".join(mine)
            ends = sum(line.endswith((b"\n", b"\r")) for line in mine)
            assert sum(n for _, n in got) == ends or any(c is None for c, _ in got)
            whole = [c for c, _ in got if c is not None]
            assert {x for _, x in plain_lines(b"".join(whole))} <= {*mine} or len({*mine}) == 0
            # Only lines over the bound may be left out, and each leaves a mark.
            gone = len(mine) - sum(len(plain_lines(c)) for c in whole)
            assert gone == sum(c is None for c, _ in got) and gone <= sum(len(line) > longest for line in mine)
    finally:
        walk.PIECE_BYTES, walk.LINE_BYTES = old


def test_long_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    lines = [f"line {i} {'x' * (i % 90)}" for i in range(900)]
    for i in (3, 400, 899):
        lines[i] = f"id = {KEY}"
    put(tmp_path, {"long.txt": "\r\n".join(lines).encode(), "short.txt": LEAK, "one.txt": b"x" * 9000 + LEAK, "bin": b"\0" + "\n".join(lines).encode()})
    expected = sorted((f"{tmp_path}/{n}", i) for n, i in (("long.txt", 4), ("long.txt", 401), ("long.txt", 900), ("short.txt", 1), ("one.txt", 1)))
    found = lambda: sorted((r.file_path, r.line_number) for r in scan_files(spark, str(tmp_path)).where("rule_id LIKE 'aws%'").collect())
    assert found() == expected
    monkeypatch.setattr(files, "RANGE_BYTES", 1000)
    assert found() == expected
    pieces = read_files(spark, str(tmp_path)).where("file_path LIKE '%long.txt'").orderBy("first_line").collect()
    assert len(pieces) > 20 and b"".join(r.content for r in pieces) == (tmp_path / "long.txt").read_bytes()
    reasons = {r.file_path.removeprefix(f"{tmp_path}/"): r.reason for r in skipped_files(spark, str(tmp_path)).collect()}
    assert reasons == {"bin": "binary content"}


def test_a_line_too_long_is_told(spark, tmp_path, monkeypatch):
    """Sizes are set before the reading functions are sent to the tasks."""
    monkeypatch.setattr(walk, "LINE_BYTES", 5000)
    monkeypatch.setattr(walk, "PIECE_BYTES", 1000)
    put(tmp_path, {"a.txt": LEAK + b"y" * 20_000 + b"\n" + LEAK, "b.txt": LEAK})
    found = sorted((r.file_path, r.line_number) for r in scan_files(spark, str(tmp_path)).where("rule_id LIKE 'aws%'").collect())
    assert found == [(f"{tmp_path}/a.txt", 1), (f"{tmp_path}/a.txt", 3), (f"{tmp_path}/b.txt", 1)]
    assert [tuple(r) for r in skipped_files(spark, str(tmp_path)).collect()] == [(f"{tmp_path}/a.txt", 20_000 + 2 * len(LEAK) + 1, "line 2 is over 5000 bytes")]


class Counting(io.BytesIO):
    """A file that counts what is read of it."""

    taken = 0

    def read(self, size=-1):
        data = super().read(size)
        Counting.taken += len(data)
        return data


def test_of_binary_files_only_the_head_is_read(monkeypatch):
    class Store:
        def open_input_file(self, path):
            return Counting(b"\0" * 50_000_000 if path.endswith("bin") else b"text\n" * 100)

    monkeypatch.setattr(walk, "filesystem", lambda path: (Store(), path, ""))
    asked = pa.RecordBatch.from_pydict({"path": ["a.bin", "b.txt", "c.bin"], "begin": [0, 0, 20_000_000], "stop": [None, None, 30_000_000], "first_line": [1, 1, 1]})
    rows = [r for b in walk.read_ranges((b"MZ",))([asked]) for r in b.to_pylist()]
    assert [(r["path"], r["problem"]) for r in rows if r["content"] is None] == [("a.bin", "binary content"), ("b.txt", None), ("c.bin", "binary content")]
    assert Counting.taken == 2 * walk.HEAD_BYTES + 2 * 500
    Counting.taken = 0
    assert [r["problem"] for b in walk.head_tests((b"MZ",))([asked]) for r in b.to_pylist()] == ["binary content", None, "binary content"]
    assert Counting.taken == 2 * walk.HEAD_BYTES + 500


def test_large_folders_are_listed_in_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "PAGE", 10)
    put(tmp_path, {f"d/{i}.py": LEAK for i in range(57)} | {"d/sub/x.py": LEAK, "e.py": LEAK})
    assert len(names(read_files(spark, str(tmp_path)), tmp_path)) == 59


def test_what_is_left_out_is_told(spark, tmp_path):
    put(tmp_path, {"a.py": LEAK, ".git/objects/o": LEAK, "d/b.py": LEAK})
    (tmp_path / "link").symlink_to(tmp_path / "d", target_is_directory=True)
    reasons = lambda **asked: {r.file_path.removeprefix(f"{tmp_path}/"): r.reason for r in skipped_files(spark, str(tmp_path), **asked).collect()}
    told = {".git": "version control", "link": "link to a folder"}
    assert reasons() == told
    manifest = spark.createDataFrame([("a.py", "A"), ("gone.py", "M"), ("old.py", "D")], "file_path STRING, status STRING")
    assert reasons(manifest=manifest) == told | {"gone.py": "missing"}


def test_empty_and_unreadable_files(spark, tmp_path):
    put(tmp_path, {"empty.py": b"", "ok.py": LEAK})
    (tmp_path / "pipe").symlink_to(tmp_path / "nowhere")
    assert texts(spark, tmp_path) == {"empty.py": "", "ok.py": LEAK.decode()}
    assert {r.file_path.removeprefix(f"{tmp_path}/"): r.reason for r in skipped_files(spark, str(tmp_path)).collect()} == {"pipe": "missing"}


def test_skipped_files(spark, tmp_path):
    put(tmp_path, {"a.py": LEAK, "nul": b"a\0b"})
    rows = skipped_files(spark, [str(tmp_path), str(tmp_path / "gone")]).collect()
    assert {r.file_path.removeprefix(f"{tmp_path}/"): r.reason for r in rows} == {"nul": "binary content", "gone": "missing"}


def test_size_cap(spark, tmp_path):
    put(tmp_path, {"at": b"a" * 50, "over": b"a" * 51})
    assert names(read_files(spark, str(tmp_path), ScanOptions(max_file_bytes=50)), tmp_path) == ["at"]
    assert names(read_files(spark, str(tmp_path)), tmp_path) == ["at", "over"]


def test_decode_and_newlines(spark, tmp_path):
    put(tmp_path, {"bytes": b"a\xffb", "lines": b"a\r\nb\rc", "empty": b"", "cut": "é".encode()[:1] + b"\xe2\x82z"})
    assert texts(spark, tmp_path) == {
        "bytes": "a�b", "lines": "a\nb\nc", "empty": "", "cut": (b"\xc3\xe2\x82z").decode("utf-8", "replace"),
    }


def test_ignore_globs(spark, tmp_path):
    put(tmp_path, {n: LEAK for n in ("a.log", "b.txt", "vendor/x.py", "src/vendor/y.py", "src/t1.py", "src/tb.py", "exact")})
    def kept(*globs):
        return names(read_files(spark, str(tmp_path), ScanOptions(ignore_globs=globs)), tmp_path)
    every = kept()
    assert len(every) == 7
    assert kept("*.log") == [n for n in every if n != "a.log"]
    assert kept("vendor/") == [n for n in every if n != "vendor/x.py"]
    assert kept("exact", "t[0-9].py") == [n for n in every if n not in ("exact", "src/t1.py")]
    assert kept("src/*") == [n for n in every if not n.startswith("src/")]
    assert kept("t[!0-9].py", "*/vendor/*") == [n for n in every if "vendor" not in n and n != "src/tb.py"]


def test_ignore_list(spark, tmp_path):
    put(tmp_path, {"ignore": "# note\n\n  *.log \u00a0\nvendor/\n   # more\n".encode()})
    assert [r.pattern for r in ignore_list(spark, str(tmp_path / "ignore")).collect()] == ["*.log", "vendor/"]
    assert load_ignore_globs(spark, str(tmp_path / "ignore")) == ("*.log", "vendor/")


def test_path_list_and_manifest(spark, tmp_path):
    put(tmp_path, {n: LEAK for n in ("a.py", "b.py", "d/c.py", "x[1].py")})
    listed = [str(tmp_path / n) for n in ("a.py", "gone.py", "x[1].py")]
    assert names(scan_files(spark, listed), tmp_path) == ["a.py", "x[1].py"]
    assert scan_files(spark, [str(tmp_path / "gone.py")]).count() == 0
    manifest = spark.createDataFrame(
        [("a.py", "A"), ("./d//c.py", "M"), ("b.py", "D"), ("gone.py", "A"), (str(tmp_path / "x[1].py"), "C")],
        "file_path STRING, status STRING",
    )
    expected = ["a.py", "d/c.py", "x[1].py"]
    assert names(scan_files(spark, str(tmp_path), manifest=manifest), tmp_path) == expected


def test_normalise(spark):
    import os

    cases = ["/a/b", "/a//b/./c/../d", "a/b", "./x", "/../x", "//a", "///a", "/", "/a/..", "a/../../.."]
    frame = spark.createDataFrame([(c,) for c in cases], "p STRING").select(paths.normalise(F.col("p"), "/root/w").alias("n"))
    assert [r.n for r in frame.collect()] == [os.path.normpath(os.path.join("/root/w", c)) for c in cases]
    urls = spark.createDataFrame([("file:/a/b",), ("file:///a/b",), ("s3a://bucket/k//x",)], "p STRING")
    assert [r[0] for r in urls.select(paths.normalise(F.col("p"))).collect()] == ["/a/b", "/a/b", "s3a://bucket/k/x"]


def test_globs_like_fnmatch(spark):
    from fnmatch import fnmatchcase

    globs = ["*", "a*", "*.py", "?.py", "[ab].py", "[!ab].py", "[a-c]x", "[]]x", "[!]]x", "[", "a[", "a.b", "a+b", "[a&&b]", "a^b", "[^a]", "x{1}", "*/v/*", "é?"]
    subjects = ["a.py", "c.py", "ax", "]x", "bx", "[", "a[", "axb", "a.b", "a+b", "&", "a^b", "^", "x{1}", "q/v/z", "é1", "a\nb", "", "/x/v/"]
    frame = spark.createDataFrame([(s,) for s in subjects], "s STRING")
    got = frame.select("s", *[F.rlike("s", F.lit(paths.glob_to_regex(g))).alias(str(i)) for i, g in enumerate(globs)]).collect()
    for row in got:
        for i, glob in enumerate(globs):
            assert row[str(i)] == fnmatchcase(row.s, glob), (row.s, glob)


def test_incremental(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, {"leak.py": LEAK, "clean.py": b"x = 1\n", "img.png": LEAK})
    table = StateTable(spark, str(tmp_path / "state"))
    first = scan_changed(spark, str(root), table, str(tmp_path / "pass1"))
    assert names(first.scanned, root) == ["clean.py", "leak.py"]
    assert "raw_value" not in first.findings.columns
    stored = {r.file_path.removeprefix(f"{root}/"): r for r in table.current().collect()}
    assert {n: r.findings_count for n, r in stored.items()} == {"clean.py": 0, "leak.py": 1}
    assert stored["leak.py"].file_hash == hashlib.sha256(LEAK).hexdigest()
    assert isinstance(stored["leak.py"].last_scanned, datetime)

    second = scan_changed(spark, str(root), table, str(tmp_path / "pass1"), previous=first.all_findings)
    assert second.scanned.count() == 0 and second.findings.count() == 0
    assert names(second.all_findings, root) == ["leak.py"]

    put(root, {"clean.py": LEAK * 2, "new.py": b"y"})
    third = scan_changed(spark, str(root), table, str(tmp_path / "pass1"), previous=second.all_findings)
    assert names(third.scanned, root) == ["clean.py", "new.py"]
    assert names(third.all_findings, root) == ["clean.py", "clean.py", "leak.py"]
    assert tuple(state.stats(table.current()).first()) == (3, 3)

    # Other rules make every file new, but only when rules are tracked.
    strict = ScanOptions(entropy_threshold=4.0)
    assert scan_changed(spark, str(root), table, str(tmp_path / "pass4"), strict).scanned.count() == 0
    assert scan_changed(spark, str(root), table, str(tmp_path / "pass5"), strict, track_rules=True).scanned.count() == 3
    assert scan_changed(spark, str(root), table, str(tmp_path / "pass6"), strict, track_rules=True).scanned.count() == 0


def test_scan_as_configured(spark, tmp_path):
    put(tmp_path / "in", {"a.py": LEAK, "b.py": LEAK})
    def scanned(**sections):
        options = ScanOptions().override(sections)
        return names(scan_configured(spark, str(tmp_path / "in"), options), tmp_path / "in")
    assert scanned() == ["a.py", "b.py"] and scanned(enabled=False) == []
    cache = {"path": str(tmp_path / "cache")}
    assert scanned(cache={**cache, "enabled": False}, reporting={"output_dir": str(tmp_path / "report")}) == ["a.py", "b.py"]
    assert not (tmp_path / "cache").exists() and written(tmp_path / "report" / "summary")[0]["summary"]["total"] == 2
    assert scanned(cache=cache) == scanned(cache=cache) == ["a.py", "b.py"]
    (tmp_path / "in" / "a.py").unlink()
    put(tmp_path / "in", {"c.py": LEAK})
    assert scanned(cache=cache) == ["b.py", "c.py"]
    assert scanned(cache=cache, rules={"aws": False}, entropy={"enabled": False}) == []
    with pytest.raises(ValueError, match="unknown options"):
        ScanOptions().override({"cache": {"nosuch": 1}})


class Passes:
    """Passes over a tree, each with the findings of the last one."""

    def __init__(self, spark, tmp_path):
        self.spark, self.root, self.out, self.last = spark, tmp_path / "tree", str(tmp_path / "passes"), None
        self.table = StateTable(spark, str(tmp_path / "state"), buckets=2)

    def put(self, files, when=1_700_000_000):
        put(self.root, files)
        for name in files:
            os.utime(self.root / name, (when, when))

    def __call__(self, path=None, options=ScanOptions(), **asked):
        """Names of files opened, of files scanned, and of all files with findings."""
        done = scan_changed(self.spark, path or str(self.root), self.table, self.out, options, previous=self.last, **asked)
        self.last = done.all_findings
        return tuple(sorted({*names(frame, self.root)}) for frame in (done.opened, done.scanned, done.all_findings))


@pytest.fixture
def passes(spark, tmp_path):
    return Passes(spark, tmp_path)


def test_unchanged_files_are_not_opened(passes):
    passes.put({"leak.py": LEAK, "clean.py": b"x = 1\n", "d/other.py": LEAK})
    every = ["clean.py", "d/other.py", "leak.py"]
    leaks = ["d/other.py", "leak.py"]
    assert passes() == (every, every, leaks)
    assert passes() == ([], [], leaks)
    # Neither time nor length tell of this change, so nothing was opened.
    passes.put({"clean.py": b"y = 1\n"})
    assert passes() == ([], [], leaks)
    # Touched, with the same content: opened and not scanned, and known by its new time from then on.
    passes.put({"leak.py": LEAK}, when=1_700_000_500)
    assert passes() == (["leak.py"], [], leaks)
    assert passes() == ([], [], leaks)
    passes.put({"leak.py": b"gone\n", "d/new.py": LEAK}, when=1_700_000_900)
    assert passes() == (["d/new.py", "leak.py"], ["d/new.py", "leak.py"], ["d/new.py", "d/other.py"])
    # A file that was written a moment ago may be written again within the same tick of the clock.
    passes.put({"d/new.py": LEAK * 2}, when=time.time())
    assert passes()[1:] == (["d/new.py"], ["d/new.py", "d/other.py"])
    assert passes()[:2] == (["d/new.py"], [])


def test_restored_files_are_reported_again(passes, tmp_path):
    passes.put({"leak.py": LEAK, "d/other.py": LEAK})
    assert passes()[2] == ["d/other.py", "leak.py"]
    (passes.root / "leak.py").rename(tmp_path / "aside")
    assert passes() == ([], [], ["d/other.py"])
    assert [r.file_path.rsplit("/", 1)[1] for r in passes.table.removed().collect()] == ["leak.py"]
    (tmp_path / "aside").rename(passes.root / "leak.py")
    assert passes() == (["leak.py"], ["leak.py"], ["d/other.py", "leak.py"])
    assert passes.table.removed().count() == 0


def test_files_that_can_not_be_read_for_one_pass(passes, tmp_path):
    passes.put({"leak.py": LEAK, "other.py": LEAK})
    passes()
    # A link to nowhere stands for a file that can't be read; then it is binary, then ignored.
    (passes.root / "leak.py").rename(tmp_path / "aside")
    (passes.root / "leak.py").symlink_to(tmp_path / "nowhere")
    assert passes()[2] == ["other.py"]
    (passes.root / "leak.py").unlink()
    passes.put({"leak.py": b"\0" + LEAK})
    assert passes() == (["leak.py"], [], ["other.py"])
    passes.put({"leak.py": LEAK})
    assert passes() == (["leak.py"], ["leak.py"], ["leak.py", "other.py"])
    assert passes(options=ScanOptions(ignore_globs=("leak.*",))) == ([], [], ["other.py"])
    assert passes() == (["leak.py"], ["leak.py"], ["leak.py", "other.py"])


def test_ignore_globs_mean_the_same_in_every_pass(passes):
    """A glob that the folders above the root would match."""
    above = passes.root.parts[1] + "/"
    passes.put({"leak.py": LEAK, f"{above}inner.py": LEAK})
    options = ScanOptions(ignore_globs=(above,))
    assert passes(options=options) == (["leak.py"], ["leak.py"], ["leak.py"])
    assert names(scan_files(passes.spark, str(passes.root), options), passes.root) == ["leak.py"]


def test_a_pass_over_some_files_leaves_the_others(passes, spark):
    passes.put({n: LEAK for n in ("a.py", "b.txt", "c.py")})
    passes()
    passes.put({"a.py": b"clean"}, when=1_700_000_100)
    assert passes(path_glob="*.py") == (["a.py"], ["a.py"], ["b.txt", "c.py"])
    (passes.root / "c.py").unlink()
    manifest = spark.createDataFrame([("c.py", "M")], "file_path STRING, status STRING")
    assert passes(manifest=manifest) == ([], [], ["b.txt"])
    assert passes() == ([], [], ["b.txt"])


def test_files_in_ranges_and_lines_too_long(passes, monkeypatch):
    monkeypatch.setattr(files, "RANGE_BYTES", 500)
    passes.put({"long.txt": b"word\n" * 400 + LEAK})
    assert passes() == (["long.txt"], ["long.txt"], ["long.txt"])
    assert passes() == ([], [], ["long.txt"])
    passes.put({"long.txt": b"word\n" * 400 + LEAK}, when=1_700_000_100)
    assert passes() == (["long.txt"], [], ["long.txt"])
    monkeypatch.setattr(walk, "LINE_BYTES", 300)
    monkeypatch.setattr(walk, "PIECE_BYTES", 100)
    passes.put({"partly.txt": b"x" * 900 + b"\n" + LEAK})
    assert passes() == (["partly.txt"], [], ["long.txt", "partly.txt"])
    assert passes() == (["partly.txt"], [], ["long.txt", "partly.txt"])


def rows(spark, *values):
    frame = spark.createDataFrame([*values], "file_path STRING, file_hash STRING, findings_count BIGINT")
    return frame.withColumn("last_scanned", F.lit("2024-01-01").cast("timestamp")).select(*state.STATE_COLUMNS)


def content(table):
    return {r.file_path: (r.file_hash, r.findings_count) for r in table.current().collect()}


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir())


def test_state_table(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"), buckets=4)
    assert content(table) == {}
    table.put(rows(spark, ("a", "1", 3), ("b", "2", 1)))
    table.put(rows(spark, ("a", "9", 0)), batch="s:0")
    assert content(table) == {"a": ("9", 0), "b": ("2", 1)}
    # What the batch wrote does not count for its replay.
    assert {r.file_path: r.file_hash for r in table.current(except_batch="s:0").collect()} == {"b": "2"}
    table.put(rows(spark, ("a", "9", 0), ("c", "4", 2)), batch="s:0")
    assert content(table) == {"a": ("9", 0), "b": ("2", 1), "c": ("4", 2)}
    table.remove(rows(spark, ("b", "", 0), ("unknown", "", 0)))
    assert content(table) == {"a": ("9", 0), "c": ("4", 2)}
    assert [r.file_path for r in table.removed().collect()] == ["b"]
    table.put(rows(spark, ("b", "5", 1)))
    assert tuple(state.stats(table.current()).first()) == (3, 3) and table.removed().count() == 0
    again = StateTable(spark, str(tmp_path / "state"), buckets=4)
    assert content(again) == content(table) != {}
    table.clear()
    assert content(table) == {} and tuple(state.stats(table.current()).first()) == (0, 0)
    table.put(rows(spark, ("a", "1", 1)))
    assert content(table) == {"a": ("1", 1)}
    table.put(rows(spark).limit(0))
    assert content(table) == {"a": ("1", 1)}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"), buckets=8)
    table.put(rows(spark, *((f"p{i}", str(i), i) for i in range(64))))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    table.put(rows(spark, ("p3", "new", 1)))
    after = {p for p in (tmp_path / "state").rglob("*.parquet")}
    assert len(before) == 8 and len(after & before.keys()) == 7
    assert content(table) == {f"p{i}": (str(i), i) for i in range(64)} | {"p3": ("new", 1)}


def test_many_batches_leave_the_folders_as_they_are(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"), buckets=2)
    for i in range(25):
        table.put(rows(spark, *((f"p{i % 4 + k}", str(i), i) for k in range(8))), batch=f"s:{i}")
    assert folders(tmp_path / "state") == ["bucket=0", "bucket=1"]
    assert len(list((tmp_path / "state").rglob("*.parquet"))) == 2
    assert len(content(table)) == 11


def test_has_changed_and_lookup(spark):
    stored = rows(spark, ("same", "1", 0), ("modified", "2", 0))
    now = spark.createDataFrame([("same", "1"), ("modified", "3"), ("new", "4")], "file_path STRING, file_hash STRING")
    assert dict(map(tuple, state.has_changed(now, stored).collect())) == {"same": False, "modified": True, "new": True}
    assert dict(map(tuple, state.lookup(now, stored).collect())) == {"same": "1", "modified": "2", "new": None}


def written(path):
    return [json.loads(line) for p in sorted(path.iterdir()) if p.name.startswith("part-") for line in p.read_text().splitlines()]


def test_report(spark, tmp_path):
    put(tmp_path / "tree", {"a.py": LEAK * 2, "b.py": b'password = "hunter2hunter2"\n'})
    write_report(scan_files(spark, str(tmp_path / "tree")), str(tmp_path / "report"))
    (head,) = written(tmp_path / "report" / "summary")
    assert head["summary"] == {
        "total": 3, "by_severity": {"CRITICAL": 2, "HIGH": 1, "MEDIUM": 0, "LOW": 0}, "should_block": True, "max_severity": "CRITICAL", "files_affected": 2,
    }
    assert sorted(f["file"].rsplit("/", 1)[1] for f in written(tmp_path / "report" / "files_affected")) == ["a.py", "b.py"]
    assert sorted(f["line"] for f in written(tmp_path / "report" / "findings")) == [1, 1, 2]
    for path in (tmp_path / "report").rglob("part-*"):
        assert KEY not in path.read_text() and "hunter2hunter2" not in path.read_text()


def test_empty_report(spark, tmp_path):
    put(tmp_path / "tree", {"a.py": b"x = 1"})
    write_report(scan_files(spark, str(tmp_path / "tree")), str(tmp_path / "report"))
    (head,) = written(tmp_path / "report" / "summary")
    assert head["summary"] == {
        "total": 0, "by_severity": {"CRITICAL": 0, "HIGH": 0, "MEDIUM": 0, "LOW": 0}, "should_block": False, "max_severity": None, "files_affected": 0,
    }


def test_a_report_reads_its_findings_once(spark, tmp_path, monkeypatch):
    """The files and the summary come from counts; rows may have neither a file nor a level."""
    plans = {}

    def noted(writer, path, **options):
        plans[path.rsplit("/", 1)[1]] = writer._df._jdf.queryExecution().optimizedPlan().toString()
        return json_of(writer, path, **options)

    json_of = DataFrameWriter.json
    monkeypatch.setattr(DataFrameWriter, "json", noted)
    rows = [(f, i, "r", "d", s, "m", "v", "regex") for i, (f, s) in enumerate([("a", "low"), ("a", "HIGH"), ("a", "HIGH"), ("b", " Medium "), (None, "LOW"), ("c", None), ("b", "HIGH")])]
    schema = "file_path STRING, line_number INT, rule_id STRING, description STRING, severity STRING, matched_value STRING, raw_value STRING, detection_method STRING"
    for n, some in enumerate((rows, rows[:1], [])):
        frame = spark.createDataFrame(some, schema)
        write_report(frame, str(tmp_path / f"report{n}"), "MEDIUM")
        (head,) = written(tmp_path / f"report{n}" / "summary")
        assert head["summary"] == roll.summary(frame, "MEDIUM").first().asDict(recursive=True)
        files = [f.get("file") for f in written(tmp_path / f"report{n}" / "files_affected")]
        assert sorted(files, key=str) == sorted({r[0] for r in some}, key=str)
    assert set(plans) == {"findings", "files_affected", "summary"}
    assert " json" not in plans["files_affected"] and " json" not in plans["summary"]


def test_findings_table(spark, tmp_path):
    put(tmp_path / "tree", {"a.py": LEAK})
    write_findings(scan_files(spark, str(tmp_path / "tree")), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted(roll.public_findings(scan_files(spark, str(tmp_path / "tree"))).columns)
    assert (tmp_path / "out" / "severity=CRITICAL").exists()


@pytest.mark.parametrize("salt", ["", "rules"])
def test_fingerprint(spark, salt):
    frame = spark.createDataFrame([(b"hello",), (b"hello",), (b"world",)], "c BINARY")
    a, b, c = (r[0] for r in frame.select(text.fingerprint(F.col("c"), salt)).collect())
    assert a == b != c and len(a) == 64


def test_files_with_a_known_hash_are_not_handed_on(tmp_path, monkeypatch):
    """Touched files are hashed and not scanned; content in several pieces is handed on before its hash is known."""
    monkeypatch.setattr(walk, "PIECE_BYTES", 400)
    put(tmp_path, {"same.py": LEAK, "other.py": LEAK, "new.py": LEAK, "pieces.py": b"word\n" * 200, "nul.py": b"\0" + LEAK})
    hashes = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("same.py", "pieces.py", "nul.py")} | {"other.py": "0" * 64}
    paths = sorted(tmp_path.iterdir())
    n = len(paths)
    columns = {"path": [str(p) for p in paths], "begin": [0] * n, "stop": pa.array([None] * n, pa.int64()), "first_line": [1] * n}
    asked = pa.record_batch(columns | {"known": pa.array([hashes.get(p.name) for p in paths], pa.string())})
    read = [r for b in walk.read_ranges((b"MZ",), hashed=True)([asked]) for r in b.to_pylist()]
    contents = {name: b"".join(r["content"] for r in read if r["content"] is not None and r["path"].endswith(f"/{name}")) for name in (p.name for p in paths)}
    assert contents == {"same.py": b"", "other.py": LEAK, "new.py": LEAK, "pieces.py": b"word\n" * 200, "nul.py": b""}
    told = {r["path"].rsplit("/", 1)[1]: (r["hash"], r["problem"]) for r in read if r["content"] is None}
    assert told["same.py"] == (hashes["same.py"], None) and told["nul.py"][1] == "binary content" and len(told) == n


def test_findings_are_carried_on_by_paths(spark):
    found = "file_path STRING, line_number INT, rule_id STRING, matched_value STRING"
    previous = spark.createDataFrame([(p, n, "r", "v") for p in ("a", "b", "c", None) for n in (1, 1)], found)
    current = spark.createDataFrame([("b", 2, "r", "v")], found)
    paths = lambda *names: spark.createDataFrame([(n,) for n in names], "file_path STRING")
    carried = state.carry_forward(previous, current, paths("b"), paths("a", "b", None))
    assert sorted((r.file_path, r.line_number) for r in carried.collect()) == [("a", 1), ("a", 1), ("b", 2)]
    # The findings meet the paths that are dropped, and no others.
    plan = carried._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "/dropped-" in carried._jdf.queryExecution().executedPlan().toString()
