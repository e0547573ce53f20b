"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from cofferlake.plans import load
from cofferlake.plans.registry import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = sorted([tuple(r[c] for c in columns) for r in df.collect()], key=_key)
    cursor = duck.execute(ORACLE_SQL[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    wanted = sorted([tuple(r[i] for i in at) for r in cursor.fetchall()], key=_key)
    assert len(found) == len(wanted)
    for f, w in zip(found, wanted, strict=True):
        assert all(_same(x, y) for x, y in zip(f, w, strict=True)), (f, w)
