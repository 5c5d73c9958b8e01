"""Queries of this subpackage against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from cuebook.llm.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    theirs = sorted([tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in cur.fetchall()], key=str)
    assert sorted(names) == cols and len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(math.isclose(x, y, rel_tol=1e-12) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)
