"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from cuebook.plans.catalog import ORACLES, QUERIES

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
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_silence_fill_and_merge_by_hand(spark):
    from cuebook.operators import timeline

    flags = spark.createDataFrame([(1, i, 10 <= i < 20 or 30 <= i < 32) for i in range(60)], "k int, i int, flag boolean")
    got = sorted((r["first"] - 1, r["last"] - 1) for r in timeline.filled(flags, "k", ["i"]).where("on").collect())
    assert got == [(0, 31)]
    cut = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 4, 5)], "k int, start int, end int")
    assert sorted((r.start, r.end) for r in timeline.merged(cut, "k").collect()) == [(0, 3), (4, 5)]


def test_stats_of_no_rows(spark):
    from cuebook.operators import tasklog
    from cuebook.sources.tables import task_log

    row = tasklog.stats(task_log(spark, DIR).where("false")).first()
    assert (row.total, row.success_rate, row.tokens, row.cost) == (0, 0.0, 0, 0.0)
