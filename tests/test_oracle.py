"""Every registered query against its DuckDB SQL."""

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.registry import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"
# Clean tables: no finding is the right answer.
MAY_BE_EMPTY = {"scan_conversations", "scan_events", "scan_benchmark"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    actual = Counter(tuple(row[c] for c in columns) for row in frame.collect())
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    expected = Counter(tuple(row[i] for i in order) for row in relation.fetchall())
    assert actual == expected
    assert name in MAY_BE_EMPTY or actual
