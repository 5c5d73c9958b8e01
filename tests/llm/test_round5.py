"""Plans that the driver must hold at once."""

import random
from pathlib import Path

from cuebook.llm import common, mixing
from cuebook.llm.common import shared_folder, table


def test_mix_is_planned_in_parts_and_leaves_no_table(spark):
    """A plan of some 30 exchanges took the driver past its memory; its parts are written one after the other, and those that the result doesn't read go."""
    top = Path(shared_folder(spark).removeprefix("file:"))
    before = set(top.glob("cut-*/*"))
    out = mixing.mix(table(spark, "/root/testdata/sf0.001", "documents"))
    assert set(top.glob("cut-*/*")) == before
    rows = out.collect()
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert rows and plan.count("Exchange ") + plan.count("BroadcastExchange") <= 4
    assert abs(sum(r.taken for r in rows) - sum({r.source: r.target for r in rows}.values())) <= len({r.source for r in rows})


def test_components_run_no_step_on_stars(spark, monkeypatch):
    """Each step is two plans more for the driver to hold; one was run just to see that nothing changed any more."""
    steps = []
    monkeypatch.setattr(common, "hub_join", lambda *a, f=common.hub_join: steps.append(a) or f(*a))
    named = lambda pairs: {(r.node, r.component) for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert named([(5, 1), (1, 6), (6, 1), (9, 8), (4, 4), (None, 1)]) == {(1, 1), (5, 1), (6, 1), (8, 8), (9, 8)} and not steps
    assert named([]) == set() and not steps
    assert named([(5, 1), (5, 2), (7, 2)]) == {(n, 1) for n in (1, 2, 5, 7)} and steps
    chain = [(n, n + 1) for n in range(0, 40)]
    assert named([*chain, (100, 99)]) == {(n, 0) for n in range(41)} | {(99, 99), (100, 99)}
    rng = random.Random(7)
    for _ in range(3):
        pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
        low = {n: n for p in pairs if p[0] != p[1] for n in p}
        for _ in range(60):
            for a, b in pairs:
                if a != b:
                    low[a] = low[b] = min(low[a], low[b])
        assert named(pairs) == set(low.items())
