"""Corpus queries that SQL can express, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from cofferlake.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(ORACLE_SQL[name])
    named = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(named)
    key = lambda row: [(v is None, str(v)) for k, v in sorted(zip(named, row)) if k != "target"]
    found, wanted = sorted((tuple(r[c] for c in named) for r in df.collect()), key=key), sorted(cursor.fetchall(), key=key)
    assert len(found) == len(wanted)
    for f, w in zip(found, wanted):
        assert all(math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) else a == b for a, b in zip(f, w)), (f, w)
