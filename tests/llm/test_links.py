"""Linked secrets and identifiers found through contexts, against plain Python; texts with very many hits."""

import math
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leakframe.llm import matching, pii, secrets

PARTS = {
    "assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX,
    "material": secrets.MATERIAL, "account": secrets.ACCOUNT, "endpoint": secrets.ENDPOINT,
}


def plain_secrets(text, scope):
    parts = []
    for kind, pattern in PARTS.items():
        for m in re.finditer(pattern, text):
            mixed = all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))
            if kind == "assign" and len(m[2]) < 12 or kind == "material" and not mixed:
                continue
            parts.append((m.start(), m.end(), kind))
    based = [p for p in parts if p[2] in secrets.BASE]
    parts = sorted(p for p in parts if p in based or all(p[1] <= b[0] or b[1] <= p[0] for b in based))
    blocks, reached = [], None
    for p in parts:
        if reached is None or p[0] - reached > scope:
            blocks.append([])
        blocks[-1].append(p)
        reached = max(p[1], reached or 0)
    found = []
    for block in blocks:
        roles = {secrets.ROLE[kind] for *_, kind in block}
        found += [p for p in block if p in based or roles & {*secrets.COMPLETED_BY[p[2]]}]
    return sorted((a, secrets.ROLE_ORDER.index(kind), b, kind) for a, b, kind in found)


def test_linked_spans_are_those_of_brute_force(spark):
    rng = random.Random(5)
    pool = [
        "AKIA" + "Z7" * 8, "deadbeef" * 3, "password = 'Abcdef1234567890'", "token: short", "Zx9" * 9, "user=bob77", "login: x@y.z", "https://h.example/p?q=1",
        "redis://cache:6379/0", "plain words here", "secret=" + "Qw8" * 9, "account: ops https://a.b", "Aa1" * 40, "client_id = 99887766",
    ]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "\n", "; ", " " + "filler " * rng.randrange(25)]) for _ in range(rng.randrange(14))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for scope in (20, secrets.SCOPE):
        got = {r.doc_id: [(s.start, secrets.ROLE_ORDER.index(s.kind), s.end, s.kind) for s in r.spans] for r in secrets.scan(docs, keep=["doc_id"], scope=scope).collect()}
        assert got == {i: plain_secrets(t, scope) for i, t in enumerate(texts)}
        assert sum(s[3] in secrets.COMPLETED_BY for spans in got.values() for s in spans) > 20


WORDS_BEFORE = re.compile(r"(?:^|[ \t\n\x0b\f\r])([^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]+[^ \t\n\x0b\f\r]+)[ \t\n\x0b\f\r]*$")


def test_words_before_a_hit_reach_over_earlier_hits(spark):
    texts = ["1 2 33 x 4", "é中 " + "7 " * 60, "a" * 500 + " " + "b" * 700 + "  \n 5", "1" * 60 + " 2", "x 1,2,3 4", "one 1", "a b" + " 9" * 3, " " * 300 + "u v\t\t8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = docs.select("doc_id", matching.hits(F.col("text"), "[0-9]++", before=True).alias("n"))
    rows = matching.placed(table, "doc_id", ["n"], True).collect()
    assert len(rows) == sum(len(re.findall("[0-9]+", t)) for t in texts)
    for r in rows:
        found = WORDS_BEFORE.search(texts[r.doc_id][: r.start])
        assert r.before == (found[1] if found else None) and texts[r.doc_id][r.start : r.end] == r.value
    # Words that run through more hits than are followed are not told.
    dense = spark.createDataFrame([(0, "a b" + ",1" * 40 + " c 5")], "doc_id long, text string")
    table = dense.select("doc_id", matching.hits(F.col("text"), "[0-9]++", before=True).alias("n"))
    before = [r.before for r in matching.placed(table, "doc_id", ["n"], True).orderBy("start").collect()]
    assert before[0] == "a b," and before[30] is None


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def plain_context(texts):
    """Rounds of trust and belief over (pattern, value) edges, until none becomes known."""
    def pattern(before):
        found = WORDS_BEFORE.search(before)
        return found and re.sub("[0-9]+", "#", re.sub("[ \t\n\x0b\f\r]+", " ", found[1].lower()))

    edges, places = {}, []
    for i, text in enumerate(texts):
        emails = [(m.start(), m.end(), m[0]) for m in EMAIL.finditer(text)]
        for a, _, value in emails:
            if p := pattern(text[:a]):
                edges[p, value] = 1.0
        for m in re.finditer(pii.CANDIDATE, text):
            if all(m.end() <= a or b <= m.start() for a, b, _ in emails) and (p := pattern(text[: m.start()])):
                edges.setdefault((p, m[0]), 0.0)
                places.append((i, m.start(), m.end(), p, m[0]))
    belief, known = {v: max(s for (_, w), s in edges.items() if w == v) for _, v in edges}, -1
    while True:
        behind = defaultdict(list)
        for p, v in edges:
            behind[p].append(belief[v] if known >= 0 else edges[p, v])
        trust = {p: sum(b) / len(b) for p, b in behind.items() if sum(x >= 0.7 for x in b) >= 3 and sum(b) >= 0.7 * len(b)}
        found = defaultdict(float)
        for p, v in edges:
            found[v] += math.log(max(1 - trust.get(p, 0.0), 1e-9))
        belief = {v: max(max(s for (_, w), s in edges.items() if w == v), 1 - math.exp(found[v])) for _, v in edges}
        now = sum(belief[v] >= 0.7 for _, v in edges)
        if now <= known:
            break
        known = now
    return {(i, a, b) for i, a, b, p, v in places if belief[v] >= 0.7 and p in trust and edges[p, v] == 0}


def test_identifiers_are_followed_to_the_last_round(spark):
    """Each layer's values stand behind the next layer's pattern, which without them is not trusted."""
    texts = []
    for layer in range(6):
        mails = [f"m{layer}x{i}@example.org" for i in range(14 if layer else 20)]
        own = [f"EMP-{layer}{i}77" for i in range(6)]
        last = [f"EMP-{layer - 1}{i}77" for i in range(6)] if layer else []
        texts += [f"some text, layer{'abcdef'[layer]} person {v} and more" for v in mails + own + last]
    texts += ["unseen words ABC-12345 there", "layera person layerb ABC-99999", "", "contact"]
    long = f"{'a' * 59} {'b' * 59}"
    texts += [f"{long} user{i}@example.org" for i in range(8)] + [f"x {long} KEY-55555", "y person KEY-66666"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, s.start, s.end) for r in pii.scan(docs, keep=["doc_id"]).collect() for s in r.spans if s.kind == "context"}
    assert got == plain_context(texts)
    values = {texts[i][a:b] for i, a, b in got}
    assert {"EMP-0077", "EMP-4077", "KEY-55555"} <= values and not {"ABC-12345", "KEY-66666"} & values


@pytest.mark.parametrize("scan", [secrets.scan, pii.scan])
def test_very_many_hits_in_one_text(spark, scan):
    """Twice the hits take twice the time or so: frames over a text's hits grow with them, none is worked out anew for each."""
    took = []
    for n in (2_000, 50_000, 100_000):
        text = " ".join(f"{i:016x} id-{i:05d} a{i}@b.cc" for i in range(n // 3))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        row = scan(docs, keep=["doc_id"]).select(F.size("spans").alias("n")).first()
        took.append(time.perf_counter() - start)
        assert row.n >= n // 3
    assert took[2] < 4 * took[1] + 5
