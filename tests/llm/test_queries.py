"""The registered queries on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from varaq.llm import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs(spark, name):
    got = Q.queries()[name](spark, DATA)
    rows = got.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    assert rows or name in ("p5_found",)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        duck.execute(f"create view {p.stem} as select * from '{p}'")
    got = Q.queries()[name](spark, DATA)
    want = duck.execute(Q.oracle_sql()[name])
    order = [c[0] for c in want.description]
    assert {tuple(r) for r in got.select(*order).collect()} == set(want.fetchall())
