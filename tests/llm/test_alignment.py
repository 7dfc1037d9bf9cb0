"""Merge path and token alignment, against plain merging and counting."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from leakframe.llm import alignment, merge_path

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ends = st.lists(st.integers(1, 60), max_size=40).map(lambda x: sorted({*x, 61}))


@settings(max_examples=300, deadline=None)
@given(ends, ends, st.sampled_from([1, 2, 3, 7, 64]))
def test_pieces_give_what_one_merge_gives(a, b, size):
    found = merge_path.overlaps(np.array(a), np.array(b), size)
    starts = lambda e: [0, *e[:-1]]
    links = [
        (i, j) for i, (s, e) in enumerate(zip(starts(a), a, strict=True)) for j, (t, f) in enumerate(zip(starts(b), b, strict=True)) if s < f and t < e
    ]
    assert list(zip(found.a.tolist(), found.b.tolist(), strict=True)) == links
    assert list(zip(found.ends_a.tolist(), found.ends_b.tolist(), strict=True)) == [(a.index(e) + 1, b.index(e) + 1) for e in a if e in b]


def test_diagonals_split_the_merge():
    a, b = np.array([1, 3, 3, 8]), np.array([2, 3, 9])
    assert merge_path.partition(a, b, np.arange(8)).tolist() == [0, 1, 1, 2, 3, 3, 4, 4]


def plain(texts):
    """Tokens, links and groups of each text, one at a time."""
    one, other = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    one.encode_special_tokens = True
    byte = {}
    spare = 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE:
            byte[chr(b)] = b
        else:
            byte[chr(spare)] = b
            spare += 1
    out = []
    for text in texts:
        text = text or ""
        ids_a = one.encode(" " + text, add_special_tokens=False).ids
        ids_b = other.encode(text)
        bytes_a = [bytes(byte[c] for c in one.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if other.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [other.id_to_piece(i)]]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append(([], [], [], []))
            continue
        cover = lambda parts: [k for k, part in enumerate(parts) for _ in part]
        links = sorted(set(zip(cover(bytes_a), cover(bytes_b), strict=True)))
        stops = lambda parts: {int(e): k for k, e in enumerate(np.cumsum([len(p) for p in parts]), 1)}
        stops_a, stops_b = stops(bytes_a), stops(bytes_b)
        groups, x, y = [], 0, 0
        for e in sorted(stops_a.keys() & stops_b.keys()):
            groups.append((ids_a[x : stops_a[e]], ids_b[y : stops_b[e]]))
            x, y = stops_a[e], stops_b[e]
        out.append((ids_a, ids_b, [(ids_a[i], ids_b[j]) for i, j in links], groups))
    return out


def expected(texts):
    cut = plain(texts)
    held = Counter(p for _, _, links, _ in cut for p in set(links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    for ids_a, ids_b, links, groups in cut:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            len(ids_a), len(ids_b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
            hashlib.sha256(written.encode()).hexdigest() if groups else "", written,
        )


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 300])
def test_alignment_of_odd_texts(spark, prose, messy, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    docs, rows = messy
    extra = [(200 + i, t) for i, t in enumerate([
        "<|endoftext|> and <s></s><unk>", "▁ piece ▁▁ marks", " leading  and   many spaces ", "tabs\tand\r\nlines\n\n", "don't we'll I'M", "<0x41> 12345 67",
        "naïve Übergröße 東京都 \U0001f469‍\U0001f4bb é", "\x00\x01", " ", "a", "the the the the", "﻿mark", "ﬁ ligature Ⅷ ½",
    ])] + [(300 + i, prose(i, 60)) for i in range(20)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = rows + extra
    got = alignment.align(docs, BYTE, PIECE, with_groups=True).collect()
    want = [(i, *row) for (i, _), row in zip(rows, expected([t for _, t in rows]), strict=True)]
    order = lambda r: (r[0] is None, r[0] or 0, r[8])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert sum(r.n_a > 0 for r in got) > 30 and sum(r.n_a == 0 and r.n_b == 0 for r in got) > 3


def test_long_texts_go_to_the_tokenizer_in_parts(prose, monkeypatch):
    text = " " + prose(1, 4000) + " it's  x\n y " + prose(2, 500)
    by = alignment.ByteTokens(open(BYTE, "rb").read())
    whole = by.encode([text])
    monkeypatch.setattr(alignment, "LONG", 100)
    assert len(alignment._parts(text)) > 50 and "".join(alignment._parts(text)) == text
    assert by.encode([text]) == whole


def test_the_faster_encoder_gives_the_same_ids(prose):
    by = alignment.ByteTokens(open(BYTE, "rb").read())
    assert by.fast is not None
    some = ["a", "1", " ", "!", "\n", "'", "é", "Ä", "²", "\u00a0", "\x1c", "\x85", "ʰ", "\u0301"]
    texts = ["".join(x + c for x in some) + c + c + "  " + c + "s" for c in map(chr, range(0x370))]
    texts += [a + b + c for a in some for b in some for c in some] + [prose(3, 300), "x" * 3000, " " * 900 + "a", "it's we'LL 've"]
    texts = [t for t in texts if alignment._LATIN.fullmatch(t)]
    fast = by.encode(texts)
    by.fast = None
    assert by.encode(texts) == fast and len(texts) > 3500


def test_an_empty_table(empty):
    assert alignment.align(empty, BYTE, PIECE).collect() == []
