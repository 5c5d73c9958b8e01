"""Operator 7: nearest neighbours with an inverted multi-index.

Two codebooks quantise the halves of a vector; a cell is a pair of centroids. For a query, a heap yields cells by growing sum of the two
distances until the cells hold the asked share of rows; the last sum is the query's reach. Rows lie in blocks sorted by cell; blocks of queries meet the
row blocks that hold a first centroid they reach, and a query measures the exact distance of the entries within its reach, of no others."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuebook.llm.common import Scratch, hash_sample
from cuebook.llm.neardup import FINE

SCHEMA = "query_id long, rank int, vec_id long, score double"
ROW_BLOCK, BLOCKS, QUERY_BLOCK = 1024, 16, 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids from evenly spaced rows as seeds; fewer when the rows are fewer. An empty centroid stays where it was."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)


def sums(v: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of a vector's halves to the centroids."""
    half = one.shape[1]
    return ((one - v[:half]) ** 2).sum(axis=1), ((two - v[half:]) ** 2).sum(axis=1)


def probe(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, want: int) -> float:
    """Sum of the last cell i * len(d2) + j taken by growing d1[i] + d2[j], from a heap, until the cells hold want rows."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    grid = sizes.reshape(len(d1), len(d2))[np.ix_(o1, o2)].tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, have, reach = [(s1[0] + s2[0], 0, 0)], 0, -1.0
    while heap and have < want:
        reach, i, j = heapq.heappop(heap)
        have += grid[i][j]
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return reach


def _clean(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(FINE).where("id is not null")


def neighbours(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, share: float = 0.4, codes: int = 128, sample: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found rows other than rows of its own id, by Euclidean distance, ties to the smaller id.

    share: part of the indexed rows that a query's cells hold at least, at every size; 1 is exact. codes: centroids a half. sample bounds the vectors (about so
    many, by smallest hash of id) that fit the codebooks; every row is indexed. Vectors that are null, zero or hold null or non-finite components take no part. A distance is of
    vectors of one length: each length that queries have is an index of its own, with its own sample. Repeated rows are found as often as they occur; of queries that repeat an id the least vector asks.
    No rows or no queries give an empty result. Other columns are ignored."""
    spark = rows.sparkSession
    keep = Scratch(spark)
    good, asked = _clean(rows, id_col, vector), _clean(queries, id_col, vector)
    out = spark.createDataFrame([], SCHEMA)
    for r in asked.select(F.size("v").alias("n")).distinct().orderBy("n").collect():
        own = F.size("v") == r.n
        out = out.unionByName(_of_length(keep, good.where(own), asked.where(own), r.n, k, share, codes, sample))
    return out


def _of_length(keep: Scratch, good: DataFrame, asked: DataFrame, dim: int, k: int, share: float, codes: int, sample: int) -> DataFrame:
    fit = np.array([r.v for r in hash_sample(good, "id", sample).select("v").collect()])
    if not len(fit):
        return good.sparkSession.createDataFrame([], SCHEMA)
    half = (dim + 1) // 2
    one, two = kmeans(fit[:, :half], codes), kmeans(fit[:, half:], codes) if dim > half else np.zeros((1, 0))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))

    def assign(batches):
        for b in batches:
            v = np.array(b["v"].tolist(), float).reshape(-1, dim)
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "cell": nearest(v[:, :half], one) * len(two) + nearest(v[:, half:], two)})

    ordered = good.mapInPandas(assign, "id long, v array<double>, cell int").repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell", "id")

    def pack(batches):
        from pyspark import TaskContext

        n, held = TaskContext.get().partitionId() << 32, []

        def block(b):
            cells = b["cell"].to_numpy(np.int32)
            return {"grp": n // BLOCKS, "firsts": sorted(set((cells // len(two)).tolist())), "ids": b["id"].to_numpy(np.int64).tobytes(), "cell": cells.tobytes(), "x": np.array(b["v"].tolist(), float).tobytes()}

        for b in batches:
            b, out = pd.concat([*held, b]), []
            for lo in range(0, len(b) - ROW_BLOCK + 1, ROW_BLOCK):
                out.append(block(b.iloc[lo : lo + ROW_BLOCK]))
                n += 1
            held = [b.iloc[len(b) - len(b) % ROW_BLOCK :]]
            if out:
                yield pd.DataFrame(out)
        if held and len(held[0]):
            yield pd.DataFrame([block(held[0])])

    blocks = keep.cut(ordered.mapInPandas(pack, "grp long, firsts array<int>, ids binary, cell binary, x binary"))
    sizes = np.zeros(len(one) * len(two), np.int64)

    def tally(batches):
        for b in batches:
            c = np.bincount(np.concatenate([np.frombuffer(z, np.int32) for z in b["cell"]]), minlength=len(sizes))
            yield pd.DataFrame({"cell": np.flatnonzero(c), "n": c[c > 0]})

    for r in blocks.select("cell").mapInPandas(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sizes[r.cell] = r.n
    want = int(np.ceil(share * sizes.sum()))

    def ask(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, len(b), QUERY_BLOCK):
                g = b.iloc[lo : lo + QUERY_BLOCK]
                q = np.array(g["v"].tolist(), float).reshape(-1, dim)
                reach, firsts = np.empty(len(q)), np.zeros(len(one), bool)
                for i, v in enumerate(q):
                    d1, d2 = sums(v, one, two)
                    reach[i] = probe(d1, d2, sizes, want)
                    firsts |= d1 + d2.min() <= reach[i]
                yield pd.DataFrame({"qblock": [n], "qfirsts": [np.flatnonzero(firsts).tolist()], "qids": [g["id"].to_numpy(np.int64).tobytes()], "q": [q.tobytes()], "reach": [reach.tobytes()]})
                n += 1

    qblocks = keep.cut(asked.mapInPandas(ask, "qblock long, qfirsts array<int>, qids binary, q binary, reach binary"))
    meet = qblocks.select("qblock", F.explode("qfirsts").alias("c")).join(blocks.select("grp", F.explode("firsts").alias("c")).distinct(), "c").select("qblock", "grp").distinct()
    met = meet.join(qblocks.drop("qfirsts"), "qblock").join(blocks.drop("firsts"), "grp")

    def rerank(batches):
        for b in batches:
            for r in b.itertuples():
                ids, cells, y = np.frombuffer(r.ids, np.int64), np.frombuffer(r.cell, np.int32), np.frombuffer(r.x, float).reshape(-1, dim)
                first, second = np.divmod(cells, len(two))
                out = []
                for i, v, reach in zip(np.frombuffer(r.qids, np.int64), np.frombuffer(r.q, float).reshape(-1, dim), np.frombuffer(r.reach, float), strict=True):
                    d1, d2 = sums(v, one, two)
                    at = np.flatnonzero((d1[first] + d2[second] <= reach) & (ids != i))
                    d = np.sqrt(((y[at] - v) ** 2).sum(axis=1))
                    if len(at) > k:
                        near = d <= np.partition(d, k - 1)[k - 1]
                        at, d = at[near], d[near]
                    best = np.lexsort((ids[at], d))[:k]
                    out.append(pd.DataFrame({"query_id": i, "vec_id": ids[at[best]], "score": d[best]}))
                yield pd.concat(out)

    near = met.mapInPandas(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
