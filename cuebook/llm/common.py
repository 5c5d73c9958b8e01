"""Shared helpers: table reading, checkpoints, word hashing and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each that may be broadcast.
BROADCAST_ROWS = 200_000
#: Fixed odd constants for 64-bit mixing.
_R = 0x9E3779B97F4A7C15
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.ones(256, bool)
_TERM[:48] = _TERM[58:65] = _TERM[91:97] = _TERM[123:128] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only on a local master, where every executor sees it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        set_ = spark.conf.get("spark.checkpoint.dir", None)
        if not set_ and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(set_ or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written in the shared folder to cut lineage, deleted when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.paths = spark, f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}", {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def free(self, *keep: DataFrame) -> None:
        """Delete the tables other than keep."""
        for path, df in self.paths.items():
            if df is not None and not any(df is k for k in keep):
                delete(self.spark, path)
                self.paths[path] = None


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within it, jobs hand at most so many rows at once to Python, for work on whole texts; a smaller setting of the session's own holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(rows, before) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def planned_joins(spark: SparkSession):
    """Within it, jobs join as planned: a side that turns out small isn't gathered and broadcast by the driver after both sides are shuffled already, which saves nothing
    in an operator of many small joins. Tables known to be small before, or asked for by F.broadcast, are broadcast as ever, and skewed joins are still split."""
    name = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def hub_join(left: DataFrame, right: DataFrame, key: str, other: str, rows: int = 4096, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key at most. Rows of a key that left uses more than so many times are dealt by other to copies of right's row."""
    hubs = left.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("_copies")).where("_copies > 1")
    few = hubs.limit(BROADCAST_ROWS + 1).count()
    if few == 0:
        return left.join(right, key, how)
    hubs = F.broadcast(hubs) if few <= BROADCAST_ROWS else hubs
    dealt = left.join(hubs, key, "left").withColumn("_salt", F.pmod(F.xxhash64(other), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    copied = right.join(hubs, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second bytes, and so on, which the shuffle's compression shortens."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def numbers(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Shared:
    """A value broadcast as bytes that carry its classes along, so that executors need no copy of this package; unpacked once a task."""

    def __init__(self, spark: SparkSession, value):
        self.held, self.value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def get(self):
        if self.value is None:
            self.value = cloudpickle.loads(self.held.value)
        return self.value


def with_fields(df: DataFrame, made: Column, names: list[str]) -> DataFrame:
    """df with the named fields of the struct made; columns of df that have these names, whatever their case, give way."""
    low = {n.lower() for n in names}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept = [c for c in df.columns if c.lower() not in low]
    held = "_made"
    while held in (c.lower() for c in kept):
        held += "_"
    return df.select(*map(quoted, kept), made.alias(held)).select(*map(quoted, kept), *[F.col(held)[n].alias(n) for n in names])


def hash_sample(df: DataFrame, col: str, want: int) -> DataFrame:
    """About want rows of df (all, if fewer), those of the smallest hashes of col: a cut-off by the number of rows, so that no task sorts or gathers them."""
    n = df.count()
    if n <= want:
        return df
    return df.where(F.xxhash64(F.col(col), F.lit(3)) < F.lit(int(want / n * 2**64) - 2**63)).limit(2 * want)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int):
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up), 1 << 16)
            inv = pow(_R, -1, 1 << 64)
            one = np.full(n, _R, np.uint64)
            one[0] = 1
            two = np.full(n, inv, np.uint64)
            two[0] = 1
            cls.up, cls.down = np.multiply.accumulate(one), np.multiply.accumulate(two)
        return cls.up, cls.down


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))


def lowered(text: str | None) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased."""
    return _LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of spans of the bytes; spans of equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _Powers.upto(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) + np.uint64(salt))


def word_hashes(b: np.ndarray, terms: bool = False, prefix: int = 0) -> np.ndarray:
    """64-bit hash of each word of the bytes, in order; terms takes [0-9A-Za-z and non-ASCII] runs instead. With prefix, those of the first so many bytes of the
    longer words follow."""
    starts, ends = spans(_TERM[b] if terms else ~_SPACE[b])
    h = span_hashes(b, starts, ends)
    if prefix:
        long = ends - starts > prefix
        h = np.r_[h, span_hashes(b, starts[long], starts[long] + prefix, 1 << 32)]
    return h


def shingles(b: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; with fewer words the whole sequence as one."""
    w = word_hashes(b)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(_R) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def settled(e: DataFrame) -> bool:
    """Whether each u of the edges has one v alone, which is no edge's u: then v is its component."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").limit(1).count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges. Only nodes with an edge appear.

    Alternating large-star and small-star steps until all edges are stars; each step is an aggregate and a join, written to the shared folder, and the ones before are
    deleted. Minima are taken before the shuffle; the neighbours of a much-used node are dealt to copies of its minimum. Null ends are ignored."""
    keep = Scratch(edges.sparkSession)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = keep.cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = keep.cut(hub_join(both.where("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")  # a row for each smaller neighbour's component: no hub is left on this side
        new = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        e = keep.cut(new.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        keep.free(e)
    else:
        raise RuntimeError("components did not settle")
    top = e.groupBy("u").agg(F.min("v").alias("component"))
    return top.select(F.col("u").alias("node"), "component").unionByName(top.select(F.col("component").alias("node"), "component").distinct())
