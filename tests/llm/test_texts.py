"""Near duplicates, decontamination, line dedup, tokens, archives, toxicity: against brute force, and on odd tables."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import public_tokenizers
from leakframe.llm import decontamination, line_dedup, near, piece_bpe, toxicity, warc
from leakframe.llm.components import components
from leakframe.llm.fm_index import FMIndex, suffix_array
from leakframe.llm.tokens import pieces, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACED = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_are_those_of_the_pattern(messy):
    texts = [t for _, t in messy[1]] + ["Äb CD", "a" * 5000 + " b"]
    w = words(pa.array(texts))
    for i, text in enumerate(texts):
        got = [bytes(w.data[w.starts[k] : w.ends[k]]).decode() for k in range(w.bounds[i], w.bounds[i + 1])]
        assert got == re.findall(SPACED, lower(text))
    spelt = {}
    for k, h in enumerate(w.hashes.tolist()):
        assert spelt.setdefault(h, bytes(w.data[w.starts[k] : w.ends[k]])) == bytes(w.data[w.starts[k] : w.ends[k]])


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300), (161, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (*range(100, 160), 161)}, **{i: 200 for i in (200, 201, 202)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    one, two = rng.integers(0, 2**64, 3000, np.uint64), rng.integers(0, 2**64, 2000, np.uint64)
    assert (np.maximum(near.sketch(one), near.sketch(two)) == near.sketch(np.concatenate([one, two]))).all()
    shared, rest = one[:1000], rng.integers(0, 2**64, 1000, np.uint64)
    for keep, out in ((900, False), (100, True)):
        other = np.concatenate([shared[:keep], rest[: 1000 - keep]])
        assert near.refuted(near.sketch(shared)[None], near.sketch(other)[None], np.array([1000]), np.array([1000]))[0] == out


def shingles(text, size):
    found = re.findall(SPACED, lower(text))
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if len(found) >= size else {tuple(found)} - {()}


def plain_groups(texts, size):
    sets, head = [shingles(t, size) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = head[i], head[j]
                head = [min(a, b) if h in (a, b) else h for h in head]
    return head, [len(s) for s in sets]


@pytest.mark.parametrize("size", [2, 5])
def test_groups_are_those_of_all_pairs(spark, prose, size):
    rng, texts = random.Random(size), ["", "one", "one", "ONE", "one two", " "]
    for seed in range(12):
        base = prose(seed, rng.choice([8, 40, 150])).split(" ")
        texts.append(" ".join(base))
        for _ in range(rng.randrange(12)):  # chains: each version is changed again
            base = [w if rng.random() > 0.03 else "new" + str(rng.random()) for w in base]
            texts.append(" ".join(base))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    head, sizes = plain_groups(texts, size)
    got = {r.doc_id: r for r in near.groups(docs, shingle_words=size).collect()}
    assert [got[i].component_id for i in range(len(texts))] == head
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (head[i] == i) for i in range(len(texts)))


def test_a_hub_joins_copies_that_are_not_alike_among_themselves(spark, prose, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    hub = prose(1, 200).replace("\n", " ").split(" ")
    rng, rows = random.Random(9), []
    for i in range(60):
        copy = list(hub)
        for at in rng.sample(range(200), 9):
            copy[at] = f"own{i}"
        rows.append((i, " ".join(copy)))
    rows.append((60, " ".join(hub)))
    got = near.groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("block_bytes", [near.BLOCK_BYTES, 4000])
def test_tiles_leave_large_components_among_themselves(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "BLOCK_BYTES", block_bytes)
    rng, roots = random.Random(4), [0] * 90 + [1000] * 20 + [2000, 2000, 3000, 4000]
    members = [(1, 5, 10_000 + i, r, 20) for i, r in enumerate(roots)] + [(2, 6, 20_000 + i, 7 if i else 8, 3) for i in range(500)]
    rng.shuffle(members)
    rows = near._in_tiles(spark.createDataFrame(members, "bucket long, band int, node long, root long, n_shingles long")).collect()
    root = {m[2]: m[3] for m in members}
    met = set()
    for tile in {(r.bucket, r.low, r.high) for r in rows}:
        inside = [r for r in rows if (r.bucket, r.low, r.high) == tile]
        assert len({r.root for r in inside}) > 1
        left, right = ([r.node for r in inside if r.tile == side] for side in tile[1:])
        met |= {frozenset((a, b)) for a in left for b in right if root[a] != root[b]}
    for bucket in (1, 2):
        nodes = [m[2] for m in members if m[0] == bucket]
        assert {frozenset((a, b)) for a in nodes for b in nodes if root[a] != root[b]} <= met
    # One stray copies each of the others once, itself once for each of their blocks.
    assert sum(r.bucket == 2 for r in rows) < 500 + 500


def test_near_groups_of_odd_tables(messy, empty):
    docs, rows = messy
    assert len(near.groups(docs).collect()) == len(rows)
    left = near.one_of_each(docs)
    assert left.columns == docs.columns
    kept = left.select("doc_id", "text").collect()
    worded = [(r.doc_id, r.text) for r in kept if r.text and r.text.strip()]
    assert len(worded) == len(set(worded))
    assert sorted(r.doc_id for r in kept if not (r.text or "").strip()) == [4, 5, 6, 12]
    assert {1, 7, 10, 13} <= {r.doc_id for r in kept} and not {2, 3} & {r.doc_id for r in kept}
    assert near.groups(empty).collect() == [] and near.one_of_each(empty).collect() == []


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 5, 100):
        codes = np.append(rng.integers(1, alphabet + 1, 200), 0)
        listed = codes.tolist()
        assert suffix_array(codes).tolist() == sorted(range(len(listed)), key=lambda i: listed[i:])


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(2)
    codes = rng.integers(1, 4, 500)
    index = FMIndex(codes, 3)
    for n in (1, 2, 5):
        phrases = rng.integers(1, 4, (20, n))
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high, strict=True):
            expected = [i for i in range(len(codes) - n + 1) if (codes[i : i + n] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(text, items):
    found, hit, names = ALNUM.findall(lower(text)), set(), set()
    for name, phrase in items:
        of = ALNUM.findall(lower(phrase))
        n = min(10, len(of))
        windows = {tuple(of[i : i + n]) for i in range(len(of) - n + 1)} if n else set()
        for i in range(len(found) - n + 1) if n else ():
            if tuple(found[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add("" if name is None else str(name))
    return len(found), len(hit), sorted(names)


@pytest.fixture(scope="module")
def contaminated(spark, prose, messy):
    items = [(i, prose(100 + i, 25)) for i in range(6)] + [(7, "Short-item, here!"), (8, "..."), (9, None), (None, prose(120, 12)), (2, prose(121, 30)), (10, "taß")]
    texts = [t for _, t in messy[1]]
    texts += [f"{prose(7, 30)} {prose(100, 25).upper()} {prose(8, 9)}", "x " + " ".join(prose(101, 25).split()[5:14]), "x " + " ".join(prose(101, 25).split()[5:15]), "a short item here b", prose(121, 30) * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, texts, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("phrase_bytes", [1 << 24, 300])
def test_decontamination_finds_what_brute_force_finds(contaminated, phrase_bytes):
    docs, texts, items, benchmark = contaminated
    got = decontamination.scan(docs, benchmark, shard_words=500, phrase_bytes=phrase_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == {i: plain_hits(t, items) for i, t in enumerate(texts)}


def test_cut_texts_hold_no_window_and_others_are_untouched(contaminated):
    docs, texts, items, benchmark = contaminated
    left = decontamination.without_spans(decontamination.scan(docs, benchmark)).collect()
    for r in left:
        if r.n_hit:
            assert plain_hits(r.text, items)[1] == 0
            assert len(ALNUM.findall(lower(r.text))) == r.n_words - r.n_hit
        else:
            assert r.text == texts[r.doc_id]


def test_a_phrase_that_very_many_items_own(spark, prose):
    """Its places in a text are made one before its owners are looked up; a repeated item is one."""
    phrase = prose(500, 12)
    benchmark = spark.createDataFrame([(f"i{i % 3000:04d}", phrase) for i in range(9000)], "item_id string, text string")
    docs = spark.createDataFrame([(i, f"{phrase} x " * 30 if i % 2 else prose(i, 50)) for i in range(200)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontamination.scan(docs, benchmark).collect()}
    every = [f"i{i:04d}" for i in range(3000)]
    assert all(got[i]["items"] == (every if i % 2 else []) for i in range(200))
    assert all(got[i].n_hit == (12 * 30 if i % 2 else 0) for i in range(200))


def test_decontamination_of_odd_tables(messy, empty, contaminated):
    docs, rows = messy
    *_, benchmark = contaminated
    assert len(decontamination.scan(docs, benchmark).collect()) == len(rows)
    assert {r.n_hit for r in decontamination.scan(docs, benchmark.limit(0)).collect()} == {0}
    assert decontamination.scan(empty, benchmark).collect() == []


def plain_runs(texts, least):
    seen, out = set(), []
    for text in texts:
        lines = [(i, tuple(re.findall(SPACED, lower(line)))) for i, line in enumerate((text or "").split("\n"))]
        lines, gone = [x for x in lines if x[1]], set()
        long = [(a, b) for a in range(len(lines)) for b in range(a, len(lines)) if sum(len(x[1]) for x in lines[a : b + 1]) >= least]
        shortest = {(a, min(b for x, b in long if x == a)) for a, _ in long} | {(max(a for a, x in long if x == b), b) for _, b in long}
        for a, b in sorted(shortest):
            window = tuple(line for _, line in lines[a : b + 1])
            if window in seen:
                gone.update(range(lines[a][0], lines[b][0] + 1))
            seen.add(window)
        out.append(gone)
    return out


def test_a_repeated_run_goes_to_its_last_line(spark, prose):
    run = [" ".join(prose(s, n).split()) for s, n in ((1, 30), (2, 25), (3, 10), (4, 3))]
    texts = ["\n".join([*run, "other end"]), "\n".join(["own start", *run, "another end"]), "\n".join(run[1:] + ["short of fifty"])]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: texts[0], 1: "own start\nanother end", 2: texts[2]}


@pytest.mark.parametrize("least", [1, 10, 50])
def test_line_runs_are_those_of_brute_force(spark, prose, least):
    rng = random.Random(least)
    pool = [prose(s, n) for s, n in ((1, 12), (2, 60), (3, 36), (4, 5))] + ["a", "b", "", " ", "X y", "x  Y"]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(12))) for _ in range(60)] + [None, "", prose(2, 60) + "\n" + prose(3, 36)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup(docs, least_words=least).collect()}
    for i, gone in enumerate(plain_runs(texts, least)):
        assert {n for run in got[i].runs for n in range(run["first"], run["last"] + 1)} == gone
        expected = texts[i] if not gone else "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in gone)
        assert got[i].text == expected


def test_line_dedup_of_odd_tables(messy, empty):
    docs, rows = messy
    got = line_dedup.dedup(docs).collect()
    assert len(got) == len(rows)
    assert line_dedup.dedup(empty).collect() == []


@pytest.fixture(scope="module")
def model():
    return piece_bpe.load(open(MODEL, "rb").read())


def test_ids_are_those_of_the_library(model, messy):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "中", "▁", "\U0001f600", "\x00", "1", "22", "<s>", "\r", "=", "//", "́", "tion", "_"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    names = [*model.ids]
    texts += ["".join(rng.choices(names, k=4)).replace("▁", " ") for _ in range(3000)] + [t or "" for _, t in messy[1]]
    assert model.encode_batch(pa.array(texts)).to_pylist() == library.encode(texts, add_eos=True)
    ids = [rng.choices(range(model.size), k=12) for _ in range(300)] + library.encode(texts[:500], add_eos=True)
    plain = [i for i in ids if not {*i} & {0}]
    assert model.decode_batch(pa.array(library.encode(texts, add_eos=True), pa.list_(pa.int32()))) == library.decode(library.encode(texts, add_eos=True))
    assert len(model.decode_batch(pa.array(plain, pa.list_(pa.int32())))) == len(plain)


def test_words_forgotten_are_encoded_again(model, prose, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHED", 5)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model.cache.clear()
    text = prose(3, 300)
    assert model.encode(text) == library.encode(text, add_eos=True)
    assert len(model.cache) <= 5


@pytest.mark.parametrize("sizes", [[5], [12], [3, 4, 12], [10], [4, 6, 10], [25, 0, 0], [0, 0], [9, 9, 9], [1, 40]])
def test_pieces_hold_every_text_once_and_none_is_empty(sizes):
    batch = pa.record_batch({"text": pa.array(["x" * n if n else None for n in sizes], pa.string())})
    found = [*pieces(iter([batch]), "text", 10)]
    assert [t for p in found for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(p.num_rows for p in found)


def test_a_batch_that_ends_with_a_long_text(spark):
    """The last text of a batch reaches over a boundary between pieces."""
    docs = spark.createDataFrame([(1, "short"), (2, "word " * 250_000)], "doc_id LONG, text STRING").coalesce(1)
    found = {r.doc_id: r.n_tokens for r in piece_bpe.round_trip(docs, MODEL).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert found == {r.doc_id: len(library.encode(r.text, add_eos=True)) for r in docs.collect()}


def test_tokens_of_odd_tables(spark, messy, empty):
    docs, rows = messy
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = piece_bpe.decode(piece_bpe.encode(docs, MODEL), MODEL).select("text", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode(r.text or "", add_eos=True) and r.decoded == library.decode(r.ids)
    digests = piece_bpe.round_trip(docs, MODEL).collect()
    expected = sorted(hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got)
    assert sorted(r.ids_sha256 for r in digests) == expected
    assert piece_bpe.encode(empty, MODEL).collect() == []


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://www.host{i % 3}.example.com:{'80' if i % 2 else '8080'}/p{i % 7}?q={i}", "same" if i % 3 == 0 else f"page {i}\r\n\r\n\x00é" * 40) for i in range(60)]
    rows += [(60, None, None), (61, "", ""), (62, "not a url\n\t", None), (None, "http://x.org/", "same"), (63, "http://x.org/a", "only"), (63, "http://x.org/a", "only"), (64, "http://[bad/", "x" * 100_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_archives_give_back_all_pages(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    table, rows = pages
    folder = str(tmp_path / "w")
    warc._make(folder)
    files = warc.archive(table.withColumn("key", F.lit(1)), folder, index_captures=10, block_lines=3)
    assert files.agg(F.sum("captures")).first()[0] == len(rows)
    got = warc.read(warc.lookup(table, folder, files), folder).collect()
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", -1), i)
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = largest.get(html or "")
        revisit = first is not None and first != i
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, None if revisit else data))
    order = lambda x: (x[0] is None, x[0] or 0)
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=order) == sorted(expected, key=order)


def test_lookups_read_captures_of_one_url(spark, pages, tmp_path):
    table, rows = pages
    folder = str(tmp_path / "w")
    warc._make(folder)
    files = warc.archive(table, folder, index_captures=5, block_lines=2)
    asked = spark.createDataFrame([("http://x.org/a",), ("http://www.X.org:80/",), ("http://nowhere.org/",)], "url string")
    got = warc.read(warc.lookup(asked, folder, files, exact=False), folder).collect()
    assert sorted((r.url, r.page_id or -1) for r in got) == [("http://x.org/", -1), ("http://x.org/a", 63), ("http://x.org/a", 63)]


def test_empty_archives(spark, pages):
    assert warc.round_trip(pages[0].limit(0)).collect() == []


@pytest.mark.parametrize(("url", "key"), [("https://www.A.example.COM:443/x?y=1", "com,example,a)/x?y=1"), ("http://a.org:8080", "org,a:8080)/"), (None, ""), ("junk", "junk")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


@pytest.fixture(scope="module")
def toxic(spark, prose):
    rng, rows = random.Random(8), []
    for i in range(1200):
        text, bad = prose(i, rng.choice([30, 80, 200])).split(" "), int(i % 4 == 0)
        if bad:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["gruntpig", "sludgehead", "gruntpigs"]))
        rows.append((i, " ".join(text), 1, bad))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_held_out_texts_are_told_apart(toxic):
    got = toxicity.judge(toxic.select("doc_id", "text"), toxic.select("doc_id", "toxic")).join(toxic.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1200 and 150 < len(held) < 350
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_never_used(toxic):
    docs, labels = toxic.select("doc_id", "text"), toxic.select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == toxicity.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.learn(docs, labels), toxicity.learn(docs, turned)
    assert np.allclose(one.curve, two.curve) and np.array_equal(one.grams, two.grams, equal_nan=True)


def test_ratios_of_ngrams_are_told_apart_however_many_there_are(spark):
    # Two n-grams that agree modulo the size of the fixed tables there once were, one toxic, one ordinary, and one never seen.
    pack = lambda word: int.from_bytes(word, "big")
    bad, slots = pack(b"zzqqx"), 2_097_143
    fine, unseen = bad - 5 * slots, bad - 7 * slots
    grams, contexts = toxicity.ratios(spark.createDataFrame([(bad, 50, 0), (fine, 0, 5000)], "gram long, bad long, fine long"))
    ratio = grams.find(np.array([bad, fine, unseen, bad]))
    assert ratio[0] > 0.5 and ratio[1] < -0.5 and np.isnan(ratio[2]) and ratio[3] == ratio[0]
    assert np.isnan(contexts.find(np.array([bad >> 8, unseen >> 8]))).tolist() == [False, True]
    assert len(np.asarray(grams)) == 2


def test_all_labelled_rows_are_counted_but_the_held_out(toxic, monkeypatch):
    folds = {r.doc_id: r.f for r in toxic.select("doc_id", toxicity.fold("doc_id").alias("f")).collect()}
    own = {i: f"w{i:04d}q" for i in folds}
    spelt = F.concat(F.lit("w"), F.lpad(F.col("doc_id").cast("string"), 4, "0"), F.lit("q"))
    docs = toxic.select("doc_id", F.concat_ws(" ", spelt, "text").alias("text"))
    for bound in (20_000, 20):
        monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", bound)
        model = toxicity.learn(docs, toxic.select("doc_id", "toxic"))
        some = [next(i for i, f in folds.items() if f == k) for k in (1, 2, 3)] + [i for i, f in folds.items() if f == toxicity.CALIBRATION]
        keys = np.array([int.from_bytes(f"{own[i][1:]}".encode(), "big") for i in some])
        assert not np.isnan(model.grams.find(keys)).any()
        hidden = [int.from_bytes(own[i][1:].encode(), "big") for i, f in folds.items() if f == toxicity.HELD_OUT]
        assert np.isnan(model.grams.find(np.array(hidden))).all()


def test_discounts_stay_below_the_counts(spark):
    rows = [(i << 8, k, 0) for i, k in enumerate([1] * 20 + [2] * 9 + [3] * 5 + [4] * 3)]
    one, two, more = toxicity._discounts(spark.createDataFrame(rows, "gram long, bad long, fine long"))["bad"]
    assert (round(one, 3), round(two, 3), round(more, 3)) == (0.526, 1.123, 1.737)
    assert toxicity._discounts(spark.createDataFrame(rows[:0], "gram long, bad long, fine long"))["fine"] == [0.75, 0.75, 0.75]
    # A rare expression counts: two n-grams of one context, each seen once, by another class.
    rows = [(0x6161616162, 1, 0), (0x6161616163, 0, 1), *[(0x7171717100 + 0x61 + i, 40, 40) for i in range(5)]]
    grams, _ = toxicity.ratios(spark.createDataFrame(rows, "gram long, bad long, fine long"))
    bad, fine = grams.find(np.array([0x6161616162, 0x6161616163]))
    assert bad > 0.05 and fine < -0.05


def test_toxicity_of_odd_tables(messy, empty, labels):
    docs, rows = messy
    for given in (labels, labels.limit(0)):
        got = toxicity.judge(docs, given).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.judge(empty, labels).collect() == []
