"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from heirline.suite import QUERIES
from oracle_queries import ORACLE

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def ordered(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in place) for r in rows), key=lambda r: tuple((x is None, repr(x)) for x in r))


def test_same_names():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, FOLDER)
    want = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(columns, want.fetchall())
