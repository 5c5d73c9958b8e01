"""Scans over keys that no task holds whole, and free names, against plain windows and simulation."""

import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from cuebook.operators import batches, names, ordered, queue, segments, timeline
from cuebook.sources import scratch


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    rows = [sorted((tuple(r[c] for c in sorted(d.columns)) for r in d.collect()), key=str) for d in (a, b)]
    assert rows[0] == rows[1] and rows[0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, True, False]), rng.choice([None, rng.randrange(50)])) for i in range(500)]
    made += [(9, None, True, 4), (9, None, False, 5)]
    return spark.createDataFrame(made, "k int, i long, flag boolean, v int").repartition(5)


def test_scans_in_ranges_equal_windows(spark, rows):
    scans = {"place": ordered.place(), "t": ordered.total("v"), "b": ordered.total_before("v"), "m": ordered.top_before("v"), "p": ordered.previous("flag"), "f": ordered.following("flag"), "l": ordered.latest("v")}
    one_key = rows.where("i is not null")
    for d, key in ((one_key, "k"), (one_key.withColumn("all", F.lit(1)), "all"), (one_key.withColumn("k2", F.col("i") % 2), ["k", "k2"])):
        large = ordered.Ordered(d, key, ["i"], 20)
        assert large.large is not None and large.large.groupBy("_chunk").count().count() > 3
        same(large.scan(**scans).rows(), ordered.Ordered(d, key, ["i"]).scan(**scans).rows())


def test_operators_under_one_hot_key(spark):
    rng = random.Random(4)
    flags = spark.createDataFrame([(1, i, rng.random() < 0.6) for i in range(400)], "k int, i int, flag boolean").repartition(4)
    most = {"most": 25}
    same(timeline.runs(flags, "k", ["i"], **most), timeline.runs(flags, "k", ["i"]))
    same(timeline.filled(flags, "k", ["i"], gap=3, **most), timeline.filled(flags, "k", ["i"], gap=3))
    same(segments.padded_runs(flags, "k", ["i"], **most), segments.padded_runs(flags, "k", ["i"]))
    parts = spark.createDataFrame([(1, s, s + rng.randrange(1, 6)) for s in rng.sample(range(1500), 300)], "k int, start int, end int")
    same(timeline.merged(parts, "k", **most), timeline.merged(parts, "k"))
    events = spark.sql("select 1 as k, id, timestamp_micros(if(id % 50 = 7, null, id * id * 1000000)) as ts, if(id % 9 = 0, null, 'a') as kind from range(300)")
    for f in (lambda **m: timeline.sessions(events, "k", "ts", "kind", "id", **m), lambda **m: timeline.clusters(events, "ts", "kind", "id", **m)):
        same(f(**most), f())
    segs = spark.sql("select 1 as file_id, id as seg_no, id * 20 as start, id * 20 + 5 + id % 7 as end from range(200)")
    same(segments.with_offsets(segs, **most), segments.with_offsets(segs))
    totals = spark.sql("select 1 as file_id, 4000 as total")
    same(segments.split_points(segs, totals, least=10, **most), segments.split_points(segs, totals, least=10))
    cues = spark.sql("select 1 as file_id, id as line_no, id * 7 as start_cs, id * 70 as start_ms from range(300)")
    same(segments.remapped(cues, segs, **most), segments.remapped(cues, segs))
    same(timeline.with_ends(cues, **most), timeline.with_ends(cues))
    same(batches.positional(cues, segs, "file_id", "line_no", "seg_no", **most), batches.positional(cues, segs, "file_id", "line_no", "seg_no"))
    moves = spark.sql("select 1 as k, id, if(id % 3 = 0, 'POLLING', 'COMPLETED') as status from range(300)")
    same(batches.state_changes(moves, "k", ["id"], **most), batches.state_changes(moves, "k", ["id"]))
    texts = spark.sql("select 1 as k, if(id % 10 = 0, 'x' || id, string(id)) as t from range(200)")
    same(queue.by_number(texts, "k", "t", **most), queue.by_number(texts, "k", "t"))
    assert scratch.release(spark) > 0


def simulated(uploads):
    taken, out = set(), []
    for name in uploads:
        path, got, k = PurePosixPath(name), name, 0
        while got in taken:
            k += 1
            got = f"{path.stem}({k}){path.suffix}"
        taken.add(got)
        out.append(got)
    return out


CHAINS = [
    ["audio.mp3"], ["audio.mp3"] * 3, ["audio.mp3", *[f"audio({i}).mp3" for i in range(1, 5)], "audio.mp3"], ["video.mp4", "video.mp4"],
    ["a.mp3", "a(1).mp3", "a.mp3"], ["a.mp3", "a.mp3", "a(1).mp3", "a(1).mp3", "a.mp3"], ["a(2).mp3", "a.mp3", "a.mp3", "a.mp3", "a(1).mp3"], ["a(1)(1)", "a(1)", "a", "a", "a(1)", "a(1)"],
    [".mp3", ".mp3", "(1).mp3", ".mp3(1)", "a(01).mp3", "a.mp3", "a.mp3", "no end", "no end", "a.b.c", "a.b.c", "x(1).y(2)", "x(1).y(2)", "x(1)(1).y(2)"],
]


@pytest.mark.parametrize("most", [7, 1_000_000])
def test_names_equal_simulation(spark, most):
    rng = random.Random(most)
    made = [rng.choice(["a", "b"]) + "".join(f"({rng.randrange(1, 9)})" for _ in range(rng.choice([0, 0, 0, 1, 1, 2]))) + ".x" for _ in range(150)]
    groups = [*CHAINS, made] if most < 1000 else CHAINS
    own = lambda i, n: n if groups[i][0] == ".mp3" else f"{i}-{n}"
    uploads = [own(i, n) for i, g in enumerate(groups) for n in g]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(uploads)] + [(-1, None, "x")], "at long, name string, stored_name2 string").repartition(3)
    got = {r.at: r.stored_name for r in names.unique_names(df, "name", "at", most).collect()}
    want = [own(i, n) for i, g in enumerate(groups) for n in simulated(g)]
    assert got.pop(-1) is None and [got[i] for i in range(len(uploads))] == want
    assert len(set(want)) == len(want)
