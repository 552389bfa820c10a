"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from pixelframe.plans.registry import QUERIES, SQL

SF = os.environ.get("PIXELFRAME_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert rows == sorted(repr(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert rows


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
