"""Operator 13: ranked lexical search in a bit-sliced impact index.

Documents lie in blocks. A term's impact in each of a block's documents is a number; bit s of it for all documents is a bitmap, the term's slice s. An item's scores are
its terms' slices added up, bit by bit with carries, for all documents at once; its best documents are found from the highest slice down, never by sorting scores."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuebook.llm.common import Scratch

#: Documents and postings of a block, items added up side by side, bytes of items' texts that one pass over the documents serves.
DOCS, POSTINGS, SIDE, PORTION = 4096, 1 << 20, 128, 1 << 22
#: Groups in which an item's candidates are cut to the best before they meet.
GROUPS = 64
BLOCK = "ids binary, known binary, n binary, doc binary, term binary, tf binary"
FOUND = "item int, item_id long, doc_id long, score long"
#: What separates terms is a blank, A-Z is lower-cased.
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_SPLIT).split()


def portions(items: DataFrame, item_id: str, text: str):
    """Lists of (id, Counter of terms), each of about PORTION bytes of text, one item at least."""
    held, size = [], 0
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).distinct().toLocalIterator():
        found = Counter(terms(r.t))
        if not found:
            continue
        if held and size + len(r.t) > PORTION:
            yield held
            held, size = [], 0
        held.append((r.i, found))
        size += len(r.t)
    if held:
        yield held


def blocks(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text: str) -> DataFrame:
    """The documents with a term, in blocks: their ids in order (null last), lengths, and postings (document, term, occurrences) of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def pack(batches):
        known = shared.value
        rows, count = [], 0

        def block():
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
            sizes = [len(r[2]) for r in rows]
            flat = lambda k: np.fromiter((x for r in rows for x in r[k]), np.int32, sum(sizes)).tobytes()
            return pd.DataFrame({
                "ids": [np.array([r[0] or 0 for r in rows], np.int64).tobytes()], "known": [np.array([r[0] is not None for r in rows]).tobytes()], "n": [np.array([r[1] for r in rows], np.int64).tobytes()],
                "doc": [np.repeat(np.arange(len(rows), dtype=np.int32), sizes).tobytes()], "term": [flat(2)], "tf": [flat(3)],
            })

        for b in batches:
            for i, t in zip(b["i"], b["t"], strict=True):
                words = terms(t)
                if not words:
                    continue
                tf = Counter(filter(None.__ne__, map(known.get, words)))
                rows.append((None if i is None else int(i), len(words), list(tf), list(tf.values())))
                count += len(tf)
                if len(rows) >= DOCS or count >= POSTINGS:
                    yield block()
                    rows, count = [], 0
        if rows:
            yield block()

    return docs.select(F.col(id_col).cast("long").cast("string").alias("i"), F.col(text).cast("string").alias("t")).mapInPandas(pack, BLOCK)


def statistics(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and documents of each term of the vocabulary: one row a term and task is summed."""

    def tally(batches):
        n, total, df = 0, 0, np.zeros(size, np.int64)
        for b in batches:
            for lengths, term in zip(b["n"], b["term"], strict=True):
                lengths = np.frombuffer(lengths, np.int64)
                n, total = n + len(lengths), total + int(lengths.sum())
                df += np.bincount(np.frombuffer(term, np.int32), minlength=size)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[-2, -1, at], "n": np.r_[n, total, df[at]]})

    got = {r.term: r.n for r in index.select("n", "term").mapInPandas(tally, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(i, 0) for i in range(size)], np.int64)


def sliced(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int, n_docs: int) -> np.ndarray:
    """Bitmaps [slice, term, 64 documents] of the impacts' bits; an empty slice and an empty term come last."""
    words = (n_docs + 63) // 64
    deep = int(impact.max(initial=0)).bit_length()
    out = np.zeros((deep + 1, size + 1, words), np.uint64)
    at, bit = term.astype(np.int64) * words + (doc >> 6), np.uint64(1) << (doc & 63).astype(np.uint64)
    for s in range(deep):
        on = np.flatnonzero((impact >> s) & 1)
        np.bitwise_or.at(out[s].reshape(-1), at[on], bit[on])
    return out


def added(index: np.ndarray, steps: np.ndarray, shifts: np.ndarray, deep: int) -> np.ndarray:
    """Bitmaps [slice, item, 64 documents] of the sums: in each step every item takes on a term's slices, moved up by a shift, with carries."""
    empty, total = len(index) - 1, np.zeros((deep, steps.shape[1], index.shape[2]), np.uint64)
    for term, shift in zip(steps, shifts, strict=True):
        carry = np.zeros_like(total[0])
        for s in range(deep):
            own = s - shift
            more = index[np.where((own >= 0) & (own < empty), own, empty), term]
            mixed = total[s] ^ more
            carry, total[s] = (total[s] & more) | (mixed & carry), mixed ^ carry
    return total


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, document) of each item's k highest sums above 0, ties to the first documents: from the highest slice down, the documents with a bit there go in as
    long as no more than k are in, else only they stay open."""
    inside, still = np.zeros_like(total[0]), np.bitwise_or.reduce(total, axis=0)
    for bits in total[::-1]:
        both = inside | (still & bits)
        many = (np.bitwise_count(both).sum(axis=1) > k)[:, None]
        inside, still = np.where(many, inside, both), still & np.where(many, bits, ~bits)
    unpack = lambda m: np.unpackbits(m.view(np.uint8), axis=1, bitorder="little").astype(bool)
    sure, tied = unpack(inside), unpack(still)
    tied &= np.cumsum(tied, axis=1) <= (k - sure.sum(axis=1))[:, None]
    return np.nonzero(sure | tied)


def plan(items: list[tuple[int | None, Counter]], vocabulary: dict[bytes, int]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first item, steps, shifts, repeats) of the items side by side; a term that an item repeats is added once for each binary digit of its repeats."""
    out = []
    for lo in range(0, len(items), SIDE):
        rows = [[(vocabulary[t], s) for t, c in found.items() for s in range(c.bit_length()) if c >> s & 1] for _, found in items[lo : lo + SIDE]]
        steps = np.full((max(map(len, rows)), len(rows)), len(vocabulary), np.int64)
        shifts = np.zeros_like(steps)
        for i, row in enumerate(rows):
            for j, (t, s) in enumerate(row):
                steps[j, i], shifts[j, i] = t, s
        out.append((lo, steps, shifts, max(sum(c.values()) for _, c in items[lo : lo + SIDE])))
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest score above 0, ties by id (null last).

    Terms are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased; scores are the whole-number sums of the terms' impacts. Items are a
    query set: portions of PORTION bytes of their text, at most, pass through the driver and each is met by all documents, block by block. Null and empty texts have no
    terms; such items find nothing. Repeated documents are found as often as they occur, a repeated item (id and text) once, two texts under one id as two lists. Empty tables
    give no rows, other columns are ignored. A task holds one block and the best k of each item."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in portions(items, item_id, item_text):
        out = out.unionByName(_portion(docs, part, k, id_col, text))
    return out


def _portion(docs: DataFrame, part, k: int, id_col: str, text: str) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in part for t in found}))}
    index = Scratch(docs.sparkSession).cut(blocks(docs, vocabulary, id_col, text))
    n_docs, n_terms, df = statistics(index, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((weight, plan(part, vocabulary), [i for i, _ in part]))

    def search(batches):
        weight, plans, names = shared.value
        held = []

        def kept():
            item, doc, missing, score = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, missing, -score, item))
            item = item[order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            order = order[place < k]
            return tuple(np.concatenate(x)[order] for x in zip(*held, strict=True))

        for b in batches:
            for r in b.itertuples():
                ids, known, n = np.frombuffer(r.ids, np.int64), np.frombuffer(r.known, bool), np.frombuffer(r.n, np.int64)
                doc, term, tf = (np.frombuffer(x, np.int32) for x in (r.doc, r.term, r.tf))
                long = 75 + 25 * n * n_docs // n_terms
                tf = tf.astype(np.int64)
                impact = weight[term] * (1000000000 * tf // (1000 * tf + 12 * long[doc]))
                slices = sliced(doc, term, impact, len(weight), len(ids))
                for lo, steps, shifts, repeats in plans:
                    total = added(slices, steps, shifts, (int(impact.max(initial=0)) * repeats).bit_length())
                    if not len(total):
                        continue
                    item, at = best(total, k)
                    score = np.zeros(len(item), np.int64)
                    for s, bits in enumerate(total):
                        score |= ((bits[item, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << s
                    held.append((item + lo, ids[at], ~known[at], score))
            if held:
                held = [kept()]
        if held:
            item, doc, missing, score = held[0]
            yield pd.DataFrame({"item": item, "item_id": pd.array([names[i] for i in item], "Int64"), "doc_id": pd.Series(doc, dtype="Int64").mask(missing), "score": score})

    near = index.mapInPandas(search, FOUND).withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item", "grp").orderBy(*order))).where(F.col("rank") <= k)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return near.select("item_id", "rank", "doc_id", "score")
