"""The pipeline's stages on planted documents, and the registered queries' names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from leakframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    passage, item = prose(900, 70).replace("\n", " "), prose(901, 30).replace("\n", " ")
    clean = [(i, prose(i, 150), 0) for i in range(300)]
    toxic = [(1000 + i, prose(2000 + i, 40).replace(" ", " gruntpig ", 6), 1) for i in range(100)]
    copies = [(2000, clean[0][1], 0), (2001, clean[1][1].replace("\n", " ") + " end", 0)]
    shared = [(3000 + i, f"{prose(4000 + i, 40)}\n{passage}\n{prose(5000 + i, 40)}", 0) for i in range(3)]
    leaked = [(6000, f"{prose(6000, 40)} {item} {prose(6001, 40)}", 0), (6001, item, 0)]
    odd = [(7000, None, 0), (7001, "", 0), (None, prose(7002, 60), 0)]
    rows = clean + toxic + copies + shared + leaked + odd
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, b) for i, _, b in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, passage, item


def test_every_stage_decides(spark, folder):
    path, rows, passage, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    states = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, path))
        states[name] = {r.doc_id: r for r in docs.collect()}
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert not any(1000 <= (i or 0) < 1100 for i in states["toxicity"])
    assert {*range(300)} - states["toxicity"].keys() == set()
    lines = states["line dedup"]
    assert sum(passage in (r.text or "") for r in lines.values()) == 1 and passage in lines[3000].text
    assert all(lines[i].n_chars == len(lines[i].text) for i in (3001, 3002)) and 2000 not in lines
    near = states["near dedup"]
    assert 1 in near and 2001 not in near
    cut = states["decontamination"]
    assert 6001 not in cut and item not in cut[6000].text and len(cut[6000].text.split()) == 80
    assert cut[5].text == rows[5][1] and cut[7000].text is None and cut[7001].text == ""
    last = states["sentencepiece"]
    assert last.keys() == cut.keys()
    assert all(r.n_tokens == len(r.ids) and r.text == (cut[i].text or "") for i, r in last.items())


def test_stages_on_odd_tables(spark, messy, empty, folder):
    path, *_ = folder
    docs, rows = messy
    docs = docs.withColumns({c: F.lit("mine") for c in ("predicted", "n_tokens", "IDS", "n_hit")}).drop("ids")
    mine = [c for c, kind in docs.dtypes if docs.schema[c].nullable is False]
    assert len(mine) > 15
    for name, stage in pipeline.STAGES:
        out = pipeline.stored(stage(spark, docs, path))
        last = name == pipeline.STAGES[-1][0]
        assert out.columns == ([c for c in docs.columns if c not in ("IDS", "n_tokens")] + ["ids", "n_tokens"] if last else docs.columns)
        found = out.collect()
        assert {r[c] for r in found for c in mine if c in docs.columns and c not in ("IDS", "n_tokens")} == {"mine"}
        assert len(found) <= len(rows) and sum(not (r.text or "").strip() for r in found) >= 4
        assert pipeline.stored(stage(spark, empty, path)).collect() == []


def test_run_applies_all_stages(spark, folder):
    path, *_ = folder
    got = pipeline.run(spark, path)
    assert {"ids", "n_tokens"} <= {*got.columns} and got.count() > 300


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert "pipeline" in pipeline.QUERIES
