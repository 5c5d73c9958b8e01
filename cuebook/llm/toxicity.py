"""Operator 5: toxicity by a factorization machine over hashed terms.

Every term (hash bucket) of enough labelled training rows has a weight and a factor vector. Term statistics over all labelled rows give each term's
pace, by how well it tells the labels apart; the machine then learns on a bounded sample of labelled rows, so that pairs of terms count beyond their
single weights. A term that no row of the sample has keeps the weight that the statistics give it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebook.llm.common import BROADCAST_ROWS, Scratch, Shared, hash_sample, lowered, numbers, planes, with_fields, word_hashes

BITS = 20
#: Bytes of a word's beginning that are a term of their own, so that forms of one stem share it.
STEM = 5


def terms(text: str | None) -> np.ndarray:
    """Distinct hash buckets of the words (ASCII letters and digits, lower-cased, and non-ASCII runs) and of longer words' beginnings, in order."""
    return np.unique(word_hashes(lowered(text), terms=True, prefix=STEM) >> np.uint64(64 - BITS)).astype(np.int64)


def packed(t: np.ndarray) -> bytes:
    """terms() as differences in byte planes."""
    return planes(np.diff(t, prepend=0).astype(np.int32))


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(numbers(b, np.int32), dtype=np.int64)


class Machine:
    def __init__(self, vocab: np.ndarray, factors: int = 4, pace: np.ndarray | None = None, start: np.ndarray | None = None):
        rng = np.random.default_rng(7)
        self.vocab, self.w0 = vocab.astype(np.int32), -2.0
        self.w, self.v = np.zeros(len(vocab), np.float32), rng.normal(0, 0.05, (len(vocab), factors)).astype(np.float32)
        self.pace = np.ones(len(vocab), np.float32) if pace is None else pace.astype(np.float32)
        self.v *= self.pace[:, None]
        self.start = None if start is None else start.astype(np.float32)

    def place(self, t: np.ndarray) -> np.ndarray:
        """Positions in the vocabulary of the document's terms."""
        if not len(self.vocab) or not len(t):
            return np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.vocab, t.astype(np.int32)), len(self.vocab) - 1)
        return k[self.vocab[k] == t]

    def logit(self, k: np.ndarray) -> float:
        """Bias, weights and all pairwise factor products, by the sum-of-squares identity."""
        f = self.v[k].astype(float)
        return self.w0 + self.w[k].sum(dtype=float) + 0.5 * float((f.sum(axis=0) ** 2 - (f * f).sum(axis=0)).sum())

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 0.1, l2: float = 5e-4):
        """Adagrad on the logistic loss, in a fixed order of batches; a batch reads and moves only the terms of its documents.

        Steps start from an accumulator of 1, so that a term of few documents moves little. Terms in no document take their start weight and lose their factors."""
        rng = np.random.default_rng(11)
        batch = min(batch, max(16, len(docs) // 24))  # small tables get as many steps as large ones
        seen = np.zeros(len(self.vocab), bool)
        for d in docs:
            seen[d] = True
        self.v[~seen] = 0
        if self.start is not None:
            self.w[~seen] = self.start[~seen]
        sw, sv, s0 = np.ones_like(self.w), np.ones_like(self.v), 1.0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                n = np.array([len(docs[i]) for i in at])
                row = np.repeat(np.arange(len(at)), n)
                u, k = np.unique(np.concatenate([docs[i] for i in at]), return_inverse=True)
                w, v = self.w[u].astype(float), self.v[u].astype(float)
                by_row = lambda x: np.bincount(row, x[k], len(at))  # noqa: B023, E731
                xv = np.stack([by_row(v[:, f]) for f in range(v.shape[1])], axis=1)
                z = self.w0 + by_row(w) + 0.5 * ((xv**2).sum(axis=1) - by_row((v * v).sum(axis=1)))
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]
                gw = np.bincount(k, g[row], len(u))
                gv = np.stack([np.bincount(k, (g * xv[:, f])[row], len(u)) for f in range(v.shape[1])], axis=1) - gw[:, None] * v
                gw, gv, g0 = gw + l2 * len(at) * w, gv + l2 * len(at) * v, g.sum()
                sw[u] += gw**2
                sv[u] += gv**2
                s0 += g0**2
                self.w[u] = w - rate * self.pace[u] * gw / np.sqrt(sw[u])
                self.v[u] = v - rate * self.pace[u, None] * gv / np.sqrt(sv[u])
                self.w0 -= rate * g0 / np.sqrt(s0)
        self.w0, self.pace, self.start = float(self.w0), None, None  # only w0, w and v are sent to executors
        return self


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 6000, support: int = 5) -> Machine:
    """Machine from the documents that labels marks 0 or 1; other and null labels are left out.

    Term counts cover all labelled documents; of equal texts with equal labels the one with the smallest key counts (a row repeated under one key counts each
    time). About sample rows (of the smallest hashes of text) take part in the factor fit. Every term of support or more rows gets a weight and factors, at most
    1 << BITS of them. Texts are never shuffled: hashes of texts meet the labels
    first, then the terms of the documents chosen."""
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    chosen = base.select("key", "h").join(marks.hint("merge"), "key").groupBy("h", "y").agg(F.min("key").alias("key"))

    def hashed(batches):
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "h": b["h"], "t": [packed(terms(t)) for t in b["text"]]})

    kind = dict(base.dtypes)["key"]
    keep = Scratch(docs.sparkSession)
    chosen = keep.cut(chosen)
    few = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # so that documents that aren't chosen are neither split into terms nor shuffled
    chosen = F.broadcast(chosen) if few else chosen
    keys = chosen.select("key", "h").distinct()
    taken = base.join(F.broadcast(keys) if few else keys, ["key", "h"], "left_semi")
    docs = taken.mapInPandas(hashed, f"key {kind}, h long, t binary").join(chosen, ["key", "h"]).select("h", "y", "t")
    docs = keep.cut(docs)  # on disk, not cached: the terms grow with the labels, and one Python worker a task is at work at a time
    n = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()

    def tally(batches):
        count, pos = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for b in batches:
            for t, y in zip(b["t"], b["y"], strict=True):
                at = unpacked(t)  # distinct within a document
                count[at] += 1
                pos[at] += y
        at = np.flatnonzero(count)
        yield pd.DataFrame({"t": at, "n": count[at], "pos": pos[at]})

    def gathered(batches):
        for b in batches:
            yield pd.DataFrame({"r": [b[["t", "n", "pos"]].to_numpy(np.int64).tobytes()]})

    stats = docs.select("t", "y").mapInPandas(tally, "t long, n long, pos long").groupBy("t").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= support)
    got = [np.frombuffer(r.r, np.int64).reshape(-1, 3) for r in stats.mapInPandas(gathered, "r binary").collect()]
    table = np.concatenate([np.empty((0, 3), np.int64), *got])
    m = Machine(*paces(table[np.argsort(table[:, 0])], n.n, n.pos))
    got = hash_sample(docs, "h", sample).collect()
    keep.free()
    got = sorted(got, key=lambda r: (r.h, r.y))
    return m.fit([m.place(unpacked(r.t)) for r in got], np.array([r.y for r in got], float)) if got and len(m.vocab) else m


def paces(stats: np.ndarray, rows: int, toxic: int):
    """(vocabulary, factors, pace, start weight) from each term's (bucket, rows, toxic rows).

    pace is 1 from a z value of 6 on and falls with its fourth power below, so that the thousands of terms that tell nothing together move little.
    The start weight is the log odds ratio moved by three standard errors towards 0, and not past it."""
    t, n, pos = stats.T
    share = toxic / max(1, rows)
    z = np.abs(pos - n * share) / np.sqrt(n * max(share * (1 - share), 1e-6) + 1)
    odds = np.log((pos + 0.5) / (n - pos + 0.5)) - np.log((toxic + 0.5) / (rows - toxic + 0.5))
    start = np.sign(odds) * np.maximum(0, np.abs(odds) - 3 * np.sqrt(1 / (pos + 0.5) + 1 / (n - pos + 0.5)))
    return t, 4, np.minimum(1, (z / 6) ** 4), start


def probability(spark, text, machine: Machine):
    """Column of the probability of label 1 of a text column; null and empty texts get that of a text without known terms."""
    hold = Shared(spark, machine)

    def run(s: pd.Series) -> pd.Series:
        m = hold.get()
        return pd.Series([1 / (1 + np.exp(-np.clip(m.logit(m.place(terms(t))), -30, 30))) for t in s], dtype=float)

    return F.pandas_udf(run, "double")(text.cast("string"))


def score(df: DataFrame, machine: Machine, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """df with score (0 to 1) and predicted (1 from the threshold on), in place of columns of these names. Null and empty texts get the score of a text without
    known terms. Rows are scored each by itself, so that repeated rows and ties get equal scores."""
    made = F.struct(probability(df.sparkSession, F.col(text), machine).alias("score"))
    out = with_fields(df, made, ["score"])
    return with_fields(out, F.struct((F.col("score") >= threshold).cast("int").alias("predicted")), ["predicted"])
