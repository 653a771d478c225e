"""Every query against its SQL, as the driver compares them: columns by name, rows in any order."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        if p.suffix == ".parquet":
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, DATA)
    want = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda rows: sorted(rows, key=repr)
    a = key(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = key(tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall())
    assert len(a) == len(b) > 0
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
