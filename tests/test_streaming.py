"""Streams against batch on the same input."""

import os

import pytest
from pyspark.sql import functions as F

from leakframe import ScanOptions, StateTable, current_findings, scan_stream, scan_table, scan_texts, stream_gate, stream_skip_seen, watch_files
from leakframe.operators.bitmap import bitmap, with_possible
from leakframe.operators.findings import public_findings
from leakframe.sources.files import file_texts, read_file_stream, read_files
from leakframe.streaming.gate import gate_batch, skip_seen_batch

SF_DIR = "/root/testdata/sf0.01"
KEY = "AKIA" + "IOSFODNN7EXAMPL2"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def stream_of(spark, name):
    schema = spark.read.parquet(f"{SF_DIR}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{SF_DIR}/{name}*.parquet")


def run(writer, checkpoint):
    query = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()


def test_scan_stream(spark, tmp_path):
    found = public_findings(scan_stream(stream_of(spark, "pages"), "page_id", "html"))
    run(found.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "cp")
    batch = public_findings(scan_table(spark.read.parquet(f"{SF_DIR}/pages.parquet"), "page_id", "html"))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(batch.columns)) == rows(batch) != []


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text(f"k = {KEY}\r\nother")
    (tmp_path / "in" / "b.png").write_text(KEY)
    found = public_findings(scan_texts(file_texts(read_file_stream(spark, str(tmp_path / "in")))))
    run(found.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "cp")
    batch = public_findings(scan_texts(file_texts(read_files(spark, str(tmp_path / "in")))))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(batch.columns)) == rows(batch) != []


def test_a_watched_tree(spark, tmp_path):
    """Hidden and empty files, and those with old times, are seen as by a batch; each turn opens what is new."""
    root, out = tmp_path / "in", str(tmp_path / "out")
    state = StateTable(spark, str(tmp_path / "state"), buckets=2)

    def turn(**files):
        for name, text in files.items():
            target = root / name.replace("__", "/").replace("DOT", ".")
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(text)
            os.utime(target, (1_600_000_000, 1_600_000_000))
        run(watch_files(spark, str(root), state, out), tmp_path / "cp")
        batch = public_findings(scan_texts(file_texts(read_files(spark, str(root)))))
        found = current_findings(spark, out, state).withColumnsRenamed({"file_path": "file", "line_number": "line"})
        assert rows(found.select(batch.columns)) == rows(batch)
        return {r.file_path.removeprefix(f"{root}/"): r.batch for r in state.details().collect()}

    first = turn(DOTenv=f"k = {KEY}", d___xDOTpy=f"a\r\nk = {KEY}", empty="", bDOTpng=KEY)
    assert first.keys() == {".env", "d/_x.py", "empty"}
    second = turn(DOTnewDOTtxt=f"k = {KEY}")
    assert second.keys() - first.keys() == {".new.txt"} and all(second[n] == first[n] for n in first)
    (root / ".env").unlink()
    assert turn().keys() == {"d/_x.py", "empty", ".new.txt"}


def test_possible_keys_are_all_found(spark):
    keys = spark.range(0, 300, 3).select(F.concat(F.lit("k"), "id").alias("k")).union(spark.createDataFrame([("",)], "k STRING"))
    every = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("t").alias("text"), "id")
    told = with_possible(every, F.col("k"), bitmap(keys, "k"), "hit")
    assert told.columns == ["k", "text", "id", "hit"]
    hits = {r.id for r in told.where("hit").collect()}
    assert hits >= {*range(0, 300, 3)} and len(hits) < 110
    none = with_possible(every, F.col("k"), bitmap(keys.limit(0), "k"), "hit")
    assert none.where("hit").count() == 0 and none.count() == 3000


def test_clean_texts_are_not_moved(spark):
    """Rows whose key can't be blocked meet only a broadcast of bounded size."""
    keys = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    plan = with_possible(spark.range(10).select(F.col("id").cast("string").alias("k"), F.lit("t").alias("text")), F.col("k"), bitmap(keys, "k"), "hit").where("NOT hit")
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shown and not any("text" in line for line in shown.split("\n") if "Exchange" in line)


@pytest.mark.parametrize("level", ["HIGH", "LOW", "CRITICAL"])
def test_gate(spark, tmp_path, level):
    options = ScanOptions(block_level=level)
    out = str(tmp_path / "out")
    run(stream_gate(stream_of(spark, "pages"), "page_id", "html", out, options), tmp_path / "cp")
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    ranks = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
    found = scan_table(pages, "page_id", "html", options)
    blocked = {r.file_path for r in found.collect() if ranks[r.severity] >= ranks[level]}
    def ids(part):
        return {str(r.page_id) for r in spark.read.parquet(f"{out}/{part}").select("page_id").collect()}
    assert ids("quarantine") == blocked
    assert ids("clean") == {str(r.page_id) for r in pages.select("page_id").collect()} - blocked
    summary = spark.read.json(f"{out}/summary").first()
    assert summary.total == found.count() and summary.should_block == bool(blocked)


def test_gate_replay(spark, tmp_path):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    out = str(tmp_path / "out")
    for _ in range(2):
        gate_batch(pages, "page_id", "html", out, 0, ScanOptions())
    parts = [spark.read.parquet(f"{out}/{p}") for p in ("clean", "quarantine")]
    assert sum(p.count() for p in parts) == pages.count()


def test_gate_without_key(spark, tmp_path):
    batch = spark.createDataFrame([(None, f"k {KEY}"), ("b", "clean"), ("c", None)], "id STRING, text STRING")
    gate_batch(batch, "id", "text", str(tmp_path), 3, ScanOptions())
    assert rows(spark.read.parquet(str(tmp_path / "clean")).select("id")) == [("b",), ("c",)]
    assert rows(spark.read.parquet(str(tmp_path / "quarantine")).select("batch")) == [(3,)]


def test_skip_seen(spark, tmp_path):
    state = StateTable(spark, str(tmp_path / "state"))
    out = str(tmp_path / "out")
    source = tmp_path / "in"

    def arrive(*values):
        spark.createDataFrame(values, "id STRING, text STRING").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id STRING, text STRING").parquet(str(source))
        run(stream_skip_seen(stream, "id", "text", out, state), tmp_path / "cp")

    arrive(("a", f"k {KEY}"), ("b", "clean"))
    arrive(("a", f"k {KEY}"), ("b", f"now {KEY}"), ("c", "new"))
    found = spark.read.parquet(f"{out}/findings")
    assert rows(found.select("batch", "file")) == [(0, "a"), (1, "b")]
    assert rows(spark.read.parquet(f"{out}/scanned").select("batch", "file_path")) == [(0, "a"), (0, "b"), (1, "b"), (1, "c")]
    assert {r.file_path: r.findings_count for r in state.current().collect()} == {"a": 1, "b": 1, "c": 0}


def test_skip_seen_replay(spark, tmp_path):
    state = StateTable(spark, str(tmp_path / "state"))
    batch = spark.createDataFrame([("a", f"k {KEY}"), ("b", "clean")], "id STRING, text STRING")
    for _ in range(2):
        skip_seen_batch(batch, "id", "text", str(tmp_path / "out"), 0, state, "s", ScanOptions())
    assert spark.read.parquet(str(tmp_path / "out" / "findings")).count() == 1
    assert state.current().select(F.sum("findings_count")).first()[0] == 1
