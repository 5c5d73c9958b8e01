"""Operator 12: periodic runs of words by a harmonic grid of longest common extensions.

For each period p, places jp and (j+1)p are compared: how far the words after them agree (forward) and those before them (backward) bounds the stretch of period p around
them, and it can't be extended. Extensions come from a suffix array of the word numbers, one of the reversed numbers, and range minima of the neighbours' common prefixes.
A run of at least `times` periods holds so many places of the grid in a row, so only those with equal words are asked; the n ln n grid itself is compared by strides."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of places whose extensions are asked at once.
ASKED = 1 << 19
FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Extensions:
    """Longest common extensions to the right of pairs of places in an array of numbers."""

    def __init__(self, x: np.ndarray):
        self.n = n = len(x)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
        order, held, step = rank.argsort(kind="stable"), [], 1
        while n and rank[order[-1]] < n - 1:  # ranks by the first 1, 2, 4 and so on numbers
            held.append(rank.astype(np.int32))
            pair = rank * (n + 1)
            pair[: n - step] += rank[step:] + 1
            order = pair.argsort(kind="stable")
            pair = pair[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.r_[0, np.cumsum(pair[1:] != pair[:-1])]
            step *= 2
        self.rank = rank
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int32)
        for level in range(len(held) - 1, -1, -1):
            r = held.pop()
            at = np.flatnonzero(np.maximum(a, b) < n)
            at = at[r[a[at]] == r[b[at]]]
            for moved in (a, b, common):
                moved[at] += 1 << level
        self.least = [common]  # least[k][i]: the least of 2^k neighbours from i on
        while len(self.least[-1]) > 1 << (len(self.least) - 1):
            low, k = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(low[:-k], low[k:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places that differ; n is the place after the last number."""
        out = np.zeros(len(a), np.int64)
        inner = np.flatnonzero(np.maximum(a, b) < self.n)
        x, y = self.rank[a[inner]], self.rank[b[inner]]
        x, y = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((y - x).astype(float))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[inner[at]] = np.minimum(self.least[k][x[at]], self.least[k][y[at] - (1 << k)])
        return out


def grid(x: np.ndarray, times: int):
    """Arrays (place, period) of the grid's places from which `times` in a row hold the same number: short periods one by one, long ones by their multiple."""
    n = len(x)
    top, root = n // times, math.isqrt(n)
    for p in range(1, min(top, root) + 1):
        y = x[::p]
        same = y[1:] == y[:-1]
        row = same[: len(same) - times + 2]
        for k in range(1, times - 1):
            row = row & same[k : len(same) - times + 2 + k]
        j = np.flatnonzero(row)
        if len(j):
            yield j * p, np.full(len(j), p)
    for j in range(n):
        last = min(top, (n - 1) // (j + times - 1))
        if last <= root:
            break
        taken = [x[k * (root + 1) : k * last + 1 : k] if k else x[:1] for k in range(j, j + times)]
        row = taken[0] == taken[1]
        for one, two in zip(taken[1:], taken[2:], strict=False):
            row = row & (one == two)
        p = root + 1 + np.flatnonzero(row)
        if len(p):
            yield j * p, p


def runs(x: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, period, length) of the maximal stretches of smallest period q with a length of at least max(least, times * q), by start, then period."""
    n, ahead, behind, found, waiting = len(x), None, None, [], []

    def ask():
        nonlocal ahead, behind
        if ahead is None:
            ahead, behind = Extensions(x), Extensions(x[::-1])
        a, p = (np.concatenate(z) for z in zip(*waiting, strict=True))
        waiting.clear()
        back = behind(n - a, n - a - p)
        rows = np.column_stack([a - back, p + back + ahead(a, a + p), p])
        found.append(np.unique(rows[rows[:, 1] >= np.maximum(least, times * p)], axis=0))

    for a, p in grid(x, times):
        waiting.append((a, p))
        if sum(len(w[0]) for w in waiting) >= ASKED:
            ask()
    if waiting:
        ask()
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)][: len(rows)]]  # of one stretch the smallest period
    rows = rows[:, [0, 2, 1]]
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def repeated(words: list, doc_id) -> list:
    """Of every tenth document by checksum of its id, the words from a place on become repeats of the words there."""
    h, n = (zlib.crc32(str(int(doc_id)).encode()) if doc_id is not None else 1), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def scan(words: list[bytes], least: int = 6, times: int = 4) -> tuple:
    """The fields of FIELDS for a list of words."""
    number: dict[bytes, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    found = runs(x, least, times)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = sha("".join(f"{s},{k},{q}\n" for s, q, k in found.tolist()).encode())
    if not len(found):
        return 0, None, None, None, None, listed, sha(b" ".join(words))
    best = None
    for s, q, k in found.tolist():
        if best is None or k * best[1] > best[2] * q:
            best = (s, q, k)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 1], 1)
    np.add.at(edge, found[:, 0] + found[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
    s, q, k = best
    return len(found), s, k, q, 1000 * k // q, listed, sha(b" ".join([words[i] for i in kept]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 6, times: int = 4, planted: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period and exponent_milli of the run with the greatest length over period (ties: smallest start, then
    period; null without a run), and digests of all runs and of the words that stay when a run keeps its first period only.

    Words are runs of anything but ASCII white space; whole texts are read. planted puts repeats into every tenth document first. Null and empty texts have no words, null ids
    get no planted repeats; repeated rows keep their rows. Other columns are ignored. A task holds one text and some twenty numbers for each of its words."""

    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for i, t in zip(ids, texts, strict=True):
            words = (t or "").encode("utf-8", "replace").split()
            out.append(scan(repeated(words, None if i is None else i) if planted else words, least, times))
        made = pd.DataFrame(out, columns=[f.split()[0] for f in FIELDS.split(", ")])
        for c in ("start", "length", "period", "exponent_milli"):
            made[c] = made[c].astype("Int64")
        return made

    held = F.col(id_col).cast("string")
    done = docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, FIELDS)(held, F.col(text).cast("string")).alias("r"))
    return done.select("doc_id", "r.*")
