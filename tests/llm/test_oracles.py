"""Queries against their DuckDB SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from leakframe.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    relation = con.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == Counter(tuple(r[i] for i in order) for r in relation.fetchall())
