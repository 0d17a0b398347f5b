from __future__ import annotations

import os
from pathlib import Path

import pytest

from tidewire.llm import queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_queries_match_their_oracles(spark):
    """All queries of this folder that SQL can express, on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, str(DATA))
        expected = db.execute(sql)
        columns = [c[0] for c in expected.description]
        order = lambda rows: sorted(map(tuple, rows), key=lambda r: tuple((v is None, v) for v in r))
        assert sorted(columns) == sorted(got.columns)
        assert order(got.select(*columns).collect()) == order(expected.fetchall()), name
