"""The Spark plan against the plain-Python specification."""

import random
import string
import time
from dataclasses import replace

import pytest
from spec import scan, spark_rows

from leakframe import Rule, ScanOptions, scan_texts
from leakframe.rules import BUILTIN_RULES
from leakframe.sources.tables import read_texts

HEX = "0123456789abcdef"
ALNUM = string.ascii_letters + string.digits
SPACES = ["", " ", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\r"]
EDGES = ["", " ", "_", ".", "-", "=", '"', "'", "é", "ñ", "İ", "ſ", "K", "/", ":", "#", "@", "😀", "\xa0", ","]


def pick(rng, alphabet, least, most=None):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most or least)))


def uuid(rng, alphabet=HEX):
    return "-".join(pick(rng, alphabet, n) for n in (8, 4, 4, 4, 12))


def body(rng):
    """Something a rule may take for its value, sometimes one character off."""
    b64 = ALNUM + "_-"
    off = rng.choice([0, 0, 0, 1, -1])
    return rng.choice([
        lambda: rng.choice(["AKIA", "ABIA", "ACCA", "ASIA", "akia"]) + pick(rng, string.ascii_uppercase + string.digits, 16 + off),
        lambda: pick(rng, ALNUM + "/+=", rng.choice([39, 40, 41, 64, 99, 100, 130])),
        lambda: "amzn.mws." + uuid(rng, rng.choice([HEX, HEX.upper()])),
        lambda: rng.choice(["eyJ", "eyj"]) + pick(rng, b64, 9, 14) + "." + rng.choice(["eyJ", ""]) + pick(rng, b64, 9, 14) + "." + pick(rng, b64, 9, 40),
        lambda: rng.choice(["Bearer", "bearer", "BEARER"]) + rng.choice(SPACES) + pick(rng, b64, 19, 22) + "." + pick(rng, b64, 10) + "." + pick(rng, b64, 10),
        lambda: "gh" + rng.choice("pousrx") + "_" + pick(rng, ALNUM, 36 + off),
        lambda: "github_pat_" + pick(rng, ALNUM + "_", rng.choice([21, 22, 82, 83])),
        lambda: rng.choice(["mysql", "Postgres", "redis", "http", "mongodb"]) + "://" + rng.choice(["", "app", "a b"]) + ":" + pick(rng, ALNUM + "#:", 7, 9) + "@" + rng.choice(["", "h", "h:1/x", " "]),
        lambda: "-----BEGIN" + rng.choice(SPACES) + rng.choice(["RSA", "EC", "DSA", "OPENSSH", "PGP", "X"]) + rng.choice(SPACES) + "PRIVATE" + rng.choice([" ", "　"]) + "KEY-----",
        lambda: "xox" + rng.choice("bporsz") + "-" + pick(rng, string.digits, 9, 11) + "-" + pick(rng, string.digits, 10) + "-" + pick(rng, ALNUM, 9, 12),
        lambda: "https://hooks.slack.com/services/T" + pick(rng, string.ascii_uppercase, 7, 9) + "/B" + pick(rng, string.ascii_uppercase, 8) + "/" + pick(rng, ALNUM, 19, 21),
        lambda: rng.choice(["sk_live_", "pk_test_", "sk_test_", "sk_prod_"]) + pick(rng, ALNUM, 19, 24),
        lambda: "SG." + pick(rng, b64, 22) + "." + pick(rng, b64, 43 + off),
        lambda: rng.choice(["SK", "sk"]) + pick(rng, HEX, 32 + off),
        lambda: "AIza" + pick(rng, b64, 35 + off),
        lambda: uuid(rng, HEX + "ABCDEF"),
        lambda: pick(rng, ALNUM + "_-", rng.choice([7, 8, 12, 19, 20, 23, 31, 45, 256, 257])),
        lambda: pick(rng, HEX, rng.choice([11, 12, 16, 20, 32, 64])),
        lambda: pick(rng, "ab", 12, 30),
    ])()


KEYS = [
    "aws_secret_access_key", "SECRET_KEY", "ſecret_key", "aws_session_token", "jwt", "TOKEN", "toKen", "refresh_token",
    "db_password", "mongo_password", "pg_password", "PASSWD", "auth", "heroku_api_key", "heroku_key", "api-key",
    "x-api-key", "apikey", "my_token", "private_key", "word", "aıpİkey",
]


def line(rng):
    parts = []
    for _ in range(rng.randint(1, 3)):
        quote = rng.choice(["", '"', "'", "&quot;"])
        value = quote + body(rng) + rng.choice([quote, quote, ""])
        if rng.random() < 0.5:
            value = rng.choice(KEYS) + rng.choice(SPACES) + rng.choice(["=", ":", "==", '":', ""]) + rng.choice(SPACES) + value
        parts.append(rng.choice(EDGES) + value + rng.choice(EDGES))
    if rng.random() < 0.03:
        parts.append("leakframe:ignore")
    return rng.choice(["", " "]).join(parts)


def random_texts(seed, n):
    rng = random.Random(seed)
    return [(str(i), "\n".join(rng.choice([line(rng), line(rng), rng.choice(SPACES), "plain words only"]) for _ in range(8))) for i in range(n)]


def assert_same(spark, texts, options=ScanOptions()):
    frame = spark.createDataFrame(texts, "file_path STRING, text STRING")
    expected = sorted(row for key, text in texts for row in scan(key, text, options))
    assert spark_rows(scan_texts(frame, options)) == expected
    return expected


def test_random_lines(spark):
    expected = assert_same(spark, random_texts(7, 1500))
    assert {row[2] for row in expected} == {r.rule_id for r in BUILTIN_RULES} | {"entropy-detection"}


@pytest.mark.parametrize("options", [
    ScanOptions(entropy_enabled=False),
    ScanOptions(rule_groups=()),
    ScanOptions(rule_groups=("aws", "github"), entropy_threshold=3.5, hex_entropy_threshold=2.0, min_length=16),
    ScanOptions(entropy_threshold=2.0, hex_entropy_threshold=4.0, max_length=40),
    ScanOptions(rule_ids=("password-in-url",), entropy_enabled=False),
    ScanOptions(ignore_line_patterns=(r"^\s*word", r"AKIA")),
    ScanOptions(custom_rules=(Rule("digits", "mine", "low", "digits", r"(\d{4})(x?)"), Rule("xyz", "mine", "HIGH", "b", r"ab+a\b", ("aba",)))),
    ScanOptions(rule_groups=(), entropy_enabled=False, custom_rules=(Rule("aba", "mine", "LOW", "b", "abab", ("ab",)),)),
])
def test_options(spark, options):
    assert_same(spark, random_texts(11, 200), options)


def test_allowlist(spark):
    texts = random_texts(13, 150)
    values = sorted({row[5] for key, text in texts for row in scan(key, text)})[::3]
    assert_same(spark, texts, ScanOptions(allowlist=tuple(v.swapcase() if v.isascii() else v for v in values)))


@pytest.mark.parametrize("table,key,text", [
    ("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"),
])
@pytest.mark.parametrize("options", [ScanOptions(), replace(ScanOptions(), entropy_threshold=3.0)])
def test_tables(spark, table, key, text, options):
    frame = read_texts(spark, f"/root/testdata/sf0.01/{table}.parquet", key, text)
    rows = [tuple(r) for r in frame.collect()]
    expected = sorted(row for k, t in rows for row in scan(k, t, options))
    assert spark_rows(scan_texts(frame, options)) == expected


def long_lines(n):
    """Minified text: ``n`` URLs on one line, with and without credentials."""
    url = "http://a.example:80/x?y=1,"
    return [
        ("none", url * n), ("early", "x://u:password@h," + url * n), ("late", url * n + "x://u:pass@h"),
        ("spaced", url * n + " ftp://u:secret123@h " + url * n + "@ " + url * 3), ("db", "redis://u:p," * n),
        ("runs", "a" + "=" * 20 * n + "b" + "-" * 20 * n), ("quotes", "'=\"a:" * n), ("hex", "0" * 20 * n),
    ]


def test_many_urls(spark):
    assert_same(spark, long_lines(150))


def test_long_lines_take_linear_time(spark):
    frame = spark.createDataFrame(long_lines(30_000), "file_path STRING, text STRING").repartition(8)
    started = time.monotonic()
    found = {r.file_path: r.raw_value for r in scan_texts(frame).collect() if r.rule_id == "password-in-url"}
    assert found == {"early": "password", "spaced": "secret123", "late": found.get("late")}
    assert time.monotonic() - started < 60
