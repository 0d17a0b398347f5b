from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).columns [:2] == ["side", "channel_id"]


@needs_data
def test_queries_match_their_oracles(spark):
    """All core queries that SQL can express, on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from tidewire.plans import domain, problems, records, reports

    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    wrong = []
    for name, sql in (problems.ORACLES | domain.ORACLES | records.ORACLES | reports.ORACLES).items():
        got = (problems.QUERIES | domain.QUERIES | records.QUERIES | reports.QUERIES)[name](spark, str(DATA))
        expected = db.execute(sql)
        columns = [c[0] for c in expected.description]
        clean = lambda v: None if isinstance(v, float) and v != v else v
        order = lambda rows: sorted((tuple(map(clean, r)) for r in rows), key=lambda r: tuple((v is None, v) for v in r))
        if sorted(columns) != sorted(got.columns) or order(expected.fetchall()) != order(tuple(r) for r in got.select(*columns).collect()):
            wrong.append(name)
    assert not wrong
