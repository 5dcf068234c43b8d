"""Queries with SQL give the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from setweave.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(str, r)) for r in cursor.fetchall()))
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == want
