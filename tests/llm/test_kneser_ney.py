"""The two class-conditional models against a plain modified Kneser-Ney model, one n-gram at a time."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leakframe.llm import toxicity


def five_grams(text):
    data = bytearray()
    for byte in text.encode():
        byte = byte + 32 if 65 <= byte <= 90 else byte
        byte = byte if chr(byte).isascii() and chr(byte).isalnum() or byte >= 128 else 32
        if not (byte == 32 and data and data[-1] == 32):
            data.append(byte)
    padded = b"    " + bytes(data)
    return [padded[i : i + 5] for i in range(len(data))]


class Plain:
    def __init__(self, rows):
        self.counts = {c: Counter(g for text, toxic in rows if toxic == c for g in five_grams(text)) for c in (0, 1)}
        seen = {*self.counts[0], *self.counts[1]}
        self.kinds = {}
        for size in (4, 2, 1):
            self.kinds[size] = Counter(g[-size:] for g in seen)
            seen = {*self.kinds[size]}
        self.cut = {}
        for c, counts in self.counts.items():
            n = Counter(counts.values())
            plain = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
            cuts = [k - (k + 1) * plain * n[k + 1] / n[k] if plain and n[k] and n[k + 1] else 0.75 for k in (1, 2, 3)]
            self.cut[c] = [0.0] + [min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), cuts, strict=True)]
        self.under = {size: defaultdict(dict) for size in self.kinds}
        for size, kinds in self.kinds.items():
            for gram, n in kinds.items():
                self.under[size][gram[:-1]][gram] = n
        self.after = {c: defaultdict(dict) for c in self.counts}
        for c, counts in self.counts.items():
            for gram, n in counts.items():
                self.after[c][gram[:-1]][gram] = n

    def shared(self, gram):
        size = len(gram)
        lower = 1 / 256 if size == 1 else self.shared(gram[-2:] if size == 4 else gram[-1:])
        siblings = self.under[size][gram[:-1]]
        return (max(siblings[gram] - 0.75, 0) + 0.75 * len(siblings) * lower) / sum(siblings.values())

    def spare(self, c, context):
        after = self.after[c].get(context, {})
        return sum(self.cut[c][min(n, 3)] for n in after.values()) / sum(after.values()) if after else 1.0

    def chance(self, c, gram):
        after = self.after[c].get(gram[:-1], {})
        n = after.get(gram, 0)
        own = (n - self.cut[c][min(n, 3)]) / sum(after.values()) if after else 0.0
        return own + self.spare(c, gram[:-1]) * self.shared(gram[-4:])

    def ratio(self, gram):
        if gram in self.counts[0] or gram in self.counts[1]:
            return math.log(self.chance(1, gram) / self.chance(0, gram))
        if gram[:-1] in self.after[0] or gram[:-1] in self.after[1]:
            return math.log(self.spare(1, gram[:-1]) / self.spare(0, gram[:-1]))
        return 0.0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    mild, harsh = ["river", "Stone", "über", "42 days", "we  walk", "中文", "o'clock"], ["gruntpig", "vile", "you rat", "über", "stone"]
    return [(" ".join(rng.choices(harsh if toxic else mild, k=rng.randrange(1, 15))) + rng.choice(["", "!", " \n "]), toxic) for toxic in [0] * 90 + [1] * 40] + [("", 0), ("  ", 1)]


def test_ratios_are_those_of_the_plain_model(spark, rows):
    plain = Plain(rows)
    counts = toxicity.count_grams(spark.createDataFrame(rows, "text string, toxic int"))
    grams, contexts = toxicity.ratios(counts)
    found = {int(k).to_bytes(5, "big"): r for k, r in np.asarray(grams)}
    seen = {*plain.counts[0], *plain.counts[1]}
    assert found.keys() == seen and len(seen) > 150
    assert all(found[g] == pytest.approx(plain.ratio(g), abs=2e-5) for g in seen)
    spares = {int(k).to_bytes(4, "big"): r for k, r in np.asarray(contexts)}
    assert all(spares[c] == pytest.approx(math.log(plain.spare(1, c) / plain.spare(0, c)), abs=2e-5) for c in {g[:-1] for g in seen})


@pytest.mark.parametrize("held", [toxicity.HELD_ROWS, 0])
def test_evidence_is_the_sum_of_ratios(spark, rows, monkeypatch, held):
    monkeypatch.setattr(toxicity, "HELD_ROWS", held)
    plain = Plain(rows)
    grams, contexts = toxicity.ratios(toxicity.count_grams(spark.createDataFrame(rows, "text string, toxic int")))
    texts = ["you vile gruntpig", "we walk by the river 42", "", "!!", "unknown zzz", rows[0][0], None]
    for _ in range(2):  # the second time with what is kept of the tables
        x = toxicity.evidence(pa.array(texts), grams, contexts)
        for text, row in zip(texts, x, strict=True):
            ratios = [plain.ratio(g) for g in five_grams(text or "")]
            assert row[1] == pytest.approx(sum(ratios) / max(len(ratios), 1), abs=1e-4)
            assert row[2] == pytest.approx(sum(ratios) / math.sqrt(len(ratios) + 1), abs=1e-3)
