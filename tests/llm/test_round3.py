"""Operators 11 to 13 against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from cuebook.llm import lexical, periodic, sharding

DOCS = "doc_id long, text string, row string, shard string"


def crc(t):
    return zlib.crc32((t or "").encode())


# operator 11


def key(t):
    return int(hashlib.md5(t.encode()).hexdigest()[:15], 16)


def check_shards(rows, texts, shards, parts=1000):
    """rows of (doc_id, size, crc, shard, slot): sizes, gapless slots, order by key, and every splitter near its share or at the nearest row of its group."""
    assert Counter((i, len((t or "").encode()) + 1, crc(t)) for i, t in texts) == Counter(r[:3] for r in rows)
    for s in range(shards):
        slots = sorted(r[4] for r in rows if r[3] == s)
        assert slots == list(range(len(slots)))
    line = sorted(rows, key=lambda r: (r[3], r[4]))
    total, below, most = sum(r[1] for r in rows), 0, max((r[1] for r in rows), default=0)
    for k in range(1, shards):
        below = sum(r[1] for r in line if r[3] < k)
        assert abs(below * shards - k * total) <= max(total / parts, most * shards / 2 + total / parts)


def shard(spark, rows, shards=4, **more):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).repartition(3)
    return [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.sharded(df, shards, **more).collect()]


def test_shards_of_small_texts(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(60)) for i in range(300)] + [(None, None), (None, ""), (7, "é"), (7, "é")]
    check_shards(shard(spark, rows), rows, 4)
    assert shard(spark, []) == []
    one = shard(spark, [(1, None)])
    assert [r[:3] + r[4:] for r in one] == [(1, 1, 0, 0)]


def test_a_hot_group_is_cut_and_small_ones_are_not(spark):
    rows = [(i, "the same text") for i in range(400)] + [(1000 + i, f"text number {i}") for i in range(400)] + [(None, "no id")] * 200
    got = shard(spark, rows)
    check_shards(got, rows, 4)
    assert len({r[3] for r in got if r[2] == crc("the same text")}) > 1
    pairs = [(2 * i + k, f"pair {i} of some words") for i in range(3000) for k in (0, 1)]
    held = {}
    for r in shard(spark, pairs, parts=100):
        held.setdefault(r[2], set()).add(r[3])
    assert all(len(s) == 1 for s in held.values())  # a pair fits within the tolerance


def test_long_text_and_repeated_rows(spark):
    rows = [(1, "a" * 300_000), (2, "b"), (2, "b"), (2, "b")] + [(5, "all alike")] * 90
    check_shards(shard(spark, rows, 3), rows, 3)


def test_shards_written_with_their_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", "x", "clash") for i in range(50)], DOCS)
    sharding.written(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == ["doc_id", "row", "shard", "slot", "text"] and back.where("row = 'x'").count() == 50
    assert back.select("shard").distinct().count() == 4


# operator 12


def naive_runs(words):
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p) and j > i:
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, p, e - s) for (s, e), p in out.items())


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.choice([3, 30, 120, 400]):
        unit = [rng.choice("ab" if seed % 2 else "abcdefgh") for _ in range(rng.randrange(1, 12))]
        words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 80)]
    number = {w: i for i, w in enumerate(sorted(set(words)))}
    import numpy as np

    got = [tuple(r) for r in periodic.runs(np.array([number[w] for w in words], np.int32)).tolist()]
    assert got == naive_runs(words)


def test_runs_asked_in_portions(monkeypatch):
    import numpy as np

    monkeypatch.setattr(periodic, "ASKED", 3)
    words = list("abcabcabcabcabcxyyyyyyyzabababababab")
    x = np.array([ord(c) for c in words], np.int32)
    assert [tuple(r) for r in periodic.runs(x).tolist()] == naive_runs(words)


def naive_row(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if i is not None and crc(str(i)) % 10 == 0 and n:
        g = crc(str(i)) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
    found = naive_runs(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    gone = {k for s, q, m in found for k in range(s + q, s + m)}
    top = max(found, key=lambda f: (Fraction(f[2], f[1]), -f[0], -f[1])) if found else None
    best = (top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4
    return (i, len(found), *best, sha("".join(f"{s},{m},{q}\n" for s, q, m in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_rows_of_runs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(1, 90)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t"), (None, "x x x x x x x"), (203, "x\x0bx\x0cx x\nx x   é"), (203, "no repeats here"), (203, "no repeats here"), (204, "long word " * 3000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS.replace("row string", "start string"))
    got = [tuple(r) for r in periodic.periodic_runs(df, planted=True).collect()]
    assert sorted(got, key=str) == sorted((naive_row(i, t) for i, t in rows), key=str)
    assert periodic.periodic_runs(df.where("false"), planted=True).count() == 0


# operator 13


def naive_search(docs, items, k=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c, m in held:
            long = 75 + 25 * m * n // total
            s = sum(w * (math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * long))) for t, w in Counter(split(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def search(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS.replace("row string", "score string")).repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    return [tuple(r) for r in lexical.ranked(d, q, **more).collect()]


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "été", "MiX", "mix"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ",-"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(300)] + [(i, "tie of words") for i in range(400, 440)]
    docs += [(None, "tie of words"), (None, None), (441, ""), (442, "..."), (443, "w1 " * 5000), (443, "w1 " * 5000)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [(50, "tie"), (51, "w1 w1 w1 w1 w1 tie"), (52, None), (53, ""), (54, "nowhere"), (None, "tie of"), (50, "tie"), (50, "w2")]
    want = sorted(naive_search(docs, items), key=str)
    assert sorted(search(spark, docs, items), key=str) == want
    monkeypatch.setattr(lexical, "SIDE", 3)
    monkeypatch.setattr(lexical, "PORTION", 40)
    monkeypatch.setattr(lexical, "DOCS", 70)
    assert sorted(search(spark, docs, items), key=str) == want


def test_search_of_nothing(spark):
    assert search(spark, [], [(1, "a")]) == [] and search(spark, [(1, "a")], []) == [] and search(spark, [(1, None)], [(1, None)]) == []
