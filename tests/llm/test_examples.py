"""Fill-in-the-middle examples, against a plain reading of the definition."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leakframe.llm import fim

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def plain_example(key, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNIT.findall(text)
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ@[`{z\x00 \n09éß中\U0001f600\x7f\x80"), max_size=40), min_size=1, max_size=6))
def test_units_and_cuts(texts):
    units = fim.Units(pa.array(texts))
    split = [UNIT.findall(t) for t in texts]
    assert units.count.tolist() == [len(s) for s in split]
    for share in (0.0, 0.3, 0.7, 1.0):
        want = np.array([int(len(s) * share) for s in split])
        heads = ["".join(s[:w]) for s, w in zip(split, want, strict=True)]
        cut = units.cut(want)
        assert cut.tolist() == [len(h.encode()) for h in heads]
        assert units.chars(cut).tolist() == [len(h) for h in heads]


def test_select_in_a_word():
    marks = np.array([0x8000000000000080, 0x8080808080808080, 0x0000008000000000], np.uint64)
    assert fim.select(marks, np.array([2, 5, 1])).tolist() == [7, 4, 4]


@pytest.mark.parametrize("seed", [1, 7])
def test_examples_are_those_of_the_definition(spark, prose, messy, seed):
    docs, rows = messy
    extra = [(100 + i, prose(i, 5 + i)) for i in range(80)] + [(300, "a<P>b"), (301, "x<M>"), (302, "<S"), (303, "<" * 30 + "S>P>" * 9), (-4, "M>" * 20)]
    docs = docs.select("doc_id", "text", "key", "row").unionByName(
        spark.createDataFrame([(i, t, "k", "r") for i, t in extra], "doc_id long, text string, key string, row string")
    )
    rows = rows + extra
    got = fim.transform(docs, seed=seed).withColumn("back", fim.restored()).collect()
    expected = [(i, *plain_example(i, t, seed), t or "") for i, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[6])
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_an_empty_table(empty):
    made = fim.transform(empty)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and made.collect() == []
