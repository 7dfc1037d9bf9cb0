import random

import pytest
from pyspark.sql import functions as F

from leakframe.llm.scratch import ready

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="session", autouse=True)
def _ready(spark):
    ready(spark)


@pytest.fixture(scope="session")
def prose():
    """Deterministic prose from a small vocabulary: prose(seed, words)."""
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("", "s", "nd", "ter", "zu", "él", "ß", "中")]

    def make(seed: int, words: int) -> str:
        chosen = random.Random(seed).choices(vocabulary, k=words)
        lines = [" ".join(chosen[i : i + 12]) for i in range(0, words, 12)]
        return "\n".join(lines)

    return make


@pytest.fixture(scope="session")
def messy(spark, prose):
    """Nulls, empty and long texts, repeated rows and keys, odd characters, and columns named like results."""
    rows = [
        (1, prose(1, 200)), (2, prose(1, 200)), (3, prose(1, 198) + " other end"), (4, ""), (5, None), (6, " \n\t "), (7, "one"),
        (8, prose(2, 60) + "\n" + prose(1, 200)), (9, "\x00 odd \x0b\x0c text\r\n ▁ \U0001f600"), (None, prose(3, 80)), (None, prose(3, 80)),
        (10, prose(4, 30_000)), (11, prose(5, 70)), (11, prose(5, 70)), (11, prose(6, 70)), (12, "x" * 50_000), (12, None), (13, "a a a a a a a a a a a a"),
    ]
    docs = spark.createDataFrame([(i, t, "en" if n % 3 else None, None, None) for n, (i, t) in enumerate(rows)], SCHEMA)
    clashing = ("kept", "spans", "shard", "score", "_row", "row", "key", "place", "n_words", "ids", "runs", "base", "email", "items", "mark", "node")
    return docs.withColumns({c: F.lit("mine") for c in clashing}), rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (7, None, None), (999, 1, 1), (11, 1, 0)], LABELS)
