"""Operator 3: exact Jaccard self-join of word shingles by size-banded tiles with bitmap signatures.

1. One scan gives each document its set size, a digest of the set and a parity bitmap of the shingles. Equal sets are one class.
2. A second scan deals shortened shingle hashes, many to a row, into buckets that count them; each doc gets back the hashes it doesn't own alone. Ordered
   by rarity, two sets at the threshold share a hash in the first fifth of both. A document whose own hashes fill its first fifth links with nothing and goes.
3. Star pass: of the classes that share a prefix hash, each meets the one with the fewest hashes of its own, a linear number of pairs. This joins groups
   of near copies without forming their pairs.
4. Tile pass: prefix hashes whose classes still lie in different components are dealt into tiles of hash, size band and chunk pair.
In both passes the bit count of two signatures' difference bounds the overlap from above before the exact intersection of the sorted arrays.
Pairs inside a known component are never needed for components, so every link between components is found. Shingles are compared by 64-bit hashes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebook.llm.common import BROADCAST_ROWS, Scratch, arrow_rows, components, hub_join, lowered, numbers, planes, planned_joins, shingles

CHUNK = 512
#: Texts that a task of Python holds at once, besides a portion.
TEXTS = 500
#: Shingles (and documents) of a task dealt out together, shingles a bucket, and uses within a task's portion from which a hash counts as common.
PORTION, MOST_DOCS, BUCKET, COMMON = 2_000_000, 60_000, 8_000_000, 32


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of 512 bits, for large sets about a bit for two shingles; each shingle flips one bit."""
    bits = max(512, 1 << max(0, math.ceil(math.log2(max(1, len(s) / 2)))))
    flip = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flip.astype(np.uint8), bitorder="little").tobytes()


def fold(m: np.ndarray, words: int) -> np.ndarray:
    """Rows of a parity bitmap folded to fewer words: the bit of a hash modulo a smaller power of two."""
    while m.shape[1] > words:
        h = m.shape[1] // 2
        m = m[:, :h] ^ m[:, h:]
    return m


def may_link(n, m, differ, percent: int):
    """Whether sets of n and m shingles whose parity bitmaps differ in so many bits can reach the similarity."""
    most = (n + m - differ) // 2
    return 100 * most >= percent * (n + m - most)


def bounded_pairs(doc, n, comp, own, maps, percent: int):
    """Candidate (a, b) of one tile: sizes fit, components differ, and the bit count leaves room for enough overlap. At least one is own."""
    doc, n, comp, own = (np.asarray(x) for x in (doc, n, comp, own))
    words = min(len(m) for m in maps) // 8
    sig = np.stack([fold(np.frombuffer(m, np.uint64)[None], words)[0] for m in maps])
    out = []
    rows = np.flatnonzero(own)
    for lo in range(0, len(rows), 64):
        r = rows[lo : lo + 64]
        later = (np.arange(len(doc))[None] > r[:, None]) | ~own[None]
        fits = later & (comp[r][:, None] != comp[None]) & (100 * np.minimum(n[r][:, None], n[None]) >= percent * np.maximum(n[r][:, None], n[None]))
        i, j = np.nonzero(fits)
        for at in range(0, len(i), 100_000):
            p, q = r[i[at : at + 100_000]], j[at : at + 100_000]
            keep = may_link(n[p], n[q], np.bitwise_count(sig[p] ^ sig[q]).sum(axis=1, dtype=np.int64), percent)
            out.append(np.c_[doc[p[keep]], doc[q[keep]]])
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def sets(docs: DataFrame, n_words: int = 5) -> DataFrame:
    """docs (id, text) as id, n, key (digest) and sig (parity bitmap)."""
    schema = docs.select("id", F.lit(0).cast("long").alias("n"), F.lit(b"").alias("key"), F.lit(b"").alias("sig")).schema

    def scan(batches):
        for b in batches:
            found = [shingles(lowered(t), n_words) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "n": [len(s) for s in found], "key": [digest(s) for s in found], "sig": [bitmap(s) for s in found]})

    return docs.mapInPandas(scan, schema)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values of a sorted array."""
    at = np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1] if len(x) else np.empty(0, np.int64)
    return at, np.diff(np.r_[at, len(x)])


USES, SUMS, BACK, DOCS = range(4)
DEALT = "bucket int, portion long, kind int, a binary, b binary, c binary"


def dealt(docs: DataFrame, bits: int, n_words: int) -> DataFrame:
    """Rows for the buckets (the first bits of a hash; 32 more bits are its low part). USES: low parts in order, as differences, and the documents' places in
    the portion; SUMS: low parts used more than COMMON times in the portion, whose uses go BACK past the count; DOCS: digests and sizes. Equal sets of a
    portion are one."""

    def portion(number, found):
        """The rows of a portion; found is emptied, and each array goes once it is used."""
        from itertools import pairwise

        n = np.array([len(s) for s in found.values()], np.uint32)
        out = [(number % (1 << bits), number, DOCS, b"".join(found), n.tobytes(), None)]
        token = np.concatenate(list(found.values()))
        found.clear()
        token >>= np.uint64(32 - bits)
        order = token.argsort(kind="stable")
        token = token[order]
        own = np.repeat(np.arange(len(n), dtype=np.uint16), n)[order]
        del order
        seen = np.unique(token[COMMON:][token[COMMON:] == token[:-COMMON]])
        if len(seen):
            common = np.zeros(len(token), bool)
            for lo, hi in zip(token.searchsorted(seen), token.searchsorted(seen, "right"), strict=True):
                common[lo:hi] = True
            for lo, size in zip(*runs(seen >> np.uint64(32)), strict=True):
                out.append((int(seen[lo] >> np.uint64(32)), number, SUMS, seen[lo : lo + size].astype(np.uint32).tobytes(), None, None))
            out.append((number % (1 << bits), number, BACK, planes(own[common]), planes(token[common]), np.full(common.sum(), COMMON, np.uint8).tobytes()))
            token, own = token[~common], own[~common]
        edge = token.searchsorted(np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        for k, (lo, hi) in enumerate(pairwise(edge.tolist())):
            if hi > lo:
                low = token[lo:hi].astype(np.uint32)
                out.append((k, number, USES, planes(np.diff(low, prepend=np.uint32(0))), planes(own[lo:hi]), None))
        return pd.DataFrame(out, columns=["bucket", "portion", "kind", "a", "b", "c"])

    def deal(batches):
        from pyspark import TaskContext

        number, found, total = TaskContext.get().partitionId() << 24, {}, 0
        for batch in batches:
            for t in batch["text"]:
                s = shingles(lowered(t), n_words)
                if not len(s) or (k := digest(s)) in found:
                    continue
                found[k], total = s, total + len(s)
                if total >= PORTION or len(found) == MOST_DOCS:
                    yield portion(number, found)
                    number, found, total = number + 1, {}, 0
        if found:
            yield portion(number, found)

    return docs.select("text").mapInPandas(deal, DEALT)


def counted(g: pd.DataFrame) -> pd.DataFrame:
    """A bucket's uses of hashes that occur more than once, with their counts (COMMON at most), as BACK rows of the portions."""
    through = g[g["kind"] >= BACK]
    uses, sums = g[g["kind"] == USES], g[g["kind"] == SUMS]
    if not len(uses):
        return through
    lows = [np.cumsum(numbers(a, np.uint32), dtype=np.uint32) for a in uses["a"]]
    size = [len(x) for x in lows]
    low, own = np.concatenate(lows), np.concatenate([numbers(b, np.uint16) for b in uses["b"]])
    del lows
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    order = low.argsort(kind="stable")
    at, length = runs(low[order])
    times = np.minimum(length, COMMON).astype(np.uint8)
    if len(sums):
        often = np.unique(np.concatenate([np.frombuffer(a, np.uint32) for a in sums["a"]]))
        times[np.isin(low[order][at], often)] = COMMON
    count = np.empty(len(low), np.uint8)
    count[order] = np.repeat(times, length)
    keep = count > 1
    low, own, row, count = low[keep], own[keep], row[keep], count[keep]
    edge = np.searchsorted(row, np.arange(len(size) + 1))
    bucket = int(g["bucket"].iloc[0])
    out = []
    for k, number in enumerate(uses["portion"]):
        lo, hi = edge[k], edge[k + 1]
        if hi > lo:
            token = low[lo:hi].astype(np.uint64) | np.uint64(bucket << 32)
            out.append((bucket, number, BACK, planes(own[lo:hi]), planes(token), count[lo:hi].tobytes()))
    return pd.concat([through, pd.DataFrame(out, columns=through.columns)], ignore_index=True)


def prefixes(docs: DataFrame, percent: int, n_words: int, total: int) -> DataFrame:
    """n, key, alone (hashes that no other document has) and prefix of the documents that can link: the shared ones of their rarest hashes, few enough to
    leave out of a set that reaches the similarity, and one more. total is the number of shingles, which only sets the number of buckets."""
    width = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = max(1, math.ceil(math.log2(max(width, total / BUCKET))))

    def first(g: pd.DataFrame) -> pd.DataFrame:
        head, back = g[g["kind"] == DOCS].iloc[0], g[g["kind"] == BACK]
        columns = ["n", "key", "alone", "prefix"]
        if not len(back):
            return pd.DataFrame([], columns=columns)
        n = np.frombuffer(head["b"], np.uint32).astype(np.int64)
        own = np.concatenate([numbers(a, np.uint16) for a in back["a"]])
        token = np.concatenate([numbers(b, np.uint64) for b in back["b"]]).view(np.int64)
        count = np.concatenate([np.frombuffer(c, np.uint8) for c in back["c"]])
        alone = n - np.bincount(own, minlength=len(n))
        most = n - -(-percent * n // 100) + 1 - alone
        keep = most[own] > 0
        own, token, count = own[keep], token[keep], count[keep]
        order = np.lexsort((token, count, own))
        own, token = own[order], token[order]
        at, length = runs(own)
        which = own[at].astype(np.int64)
        rows = zip(at, length, which, strict=True)
        return pd.DataFrame([(n[k], head["a"][16 * k : 16 * k + 16], alone[k], token[i : i + min(m, most[k])]) for i, m, k in rows], columns=columns)

    met = dealt(docs, bits, n_words).groupBy("bucket").applyInPandas(counted, DEALT)
    return met.groupBy("portion").applyInPandas(first, "n long, key binary, alone long, prefix array<long>")


def tiled(batches, percent: int):
    """Pairs of each tile of rows sorted by tile; a tile may span batches."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        tile = b[["token", "band", "i", "j"]].to_numpy()
        edge = np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1
        cuts = [0, *edge]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield from _tile(b.iloc[lo:hi], percent)
        held = b.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield from _tile(held, percent)


def _tile(g, percent):
    if len(g) < 2:
        return
    found = bounded_pairs(g["cid"].to_numpy(), g["n"].to_numpy(), g["comp"].to_numpy(), g["own"].to_numpy(), list(g["sig"]), percent)
    if len(found):
        yield pd.DataFrame({"a": found.max(axis=1), "b": found.min(axis=1)})


def tile_pairs(live: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """Candidate pairs of live (token, cid, comp, n, sig) by tiles. A pair at the threshold lies in one size band or in two neighbouring ones; one more
    band up covers rounding at the edge."""
    step = F.log(F.lit(100.0 / percent))
    live = live.withColumn("own_band", F.floor(F.log("n") / step + 1e-9).cast("int"))
    bands = F.array("own_band", F.col("own_band") - 1, F.when(F.floor(F.log("n") / step - 1e-6).cast("int") != F.col("own_band"), F.col("own_band") - 2))
    rows = live.withColumn("band", F.explode(F.array_compact(bands))).withColumn("own", F.col("band") == F.col("own_band"))
    tiles = rows.groupBy("token", "band").agg(F.count("*").alias("m"), F.max("own").alias("any"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("m > 1 and any and lo <> hi")
    tiles = keep.cut(tiles.select("token", "band", F.ceil(F.col("m") / CHUNK).cast("int").alias("parts")))
    small = tiles.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(tiles) if small else tiles, ["token", "band"]).withColumn("c", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    out = out.withColumn("d", F.explode(F.expr("sequence(0, parts - 1)")))
    out = out.select("token", "band", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "cid", "n", "comp", "own", "sig")
    width = max(8, int(live.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = out.repartition(width, "token", "band", "i", "j").sortWithinPartitions("token", "band", "i", "j", "cid")
    return out.mapInPandas(lambda x: tiled(x, percent), "a long, b long").distinct()


def bounded(pairs: DataFrame, cand: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and signatures leave room for the similarity."""
    side = cand.select("cid", "n", "sig")
    met = hub_join(pairs, side.toDF("b", "nb", "sb"), "b", "a").join(side.toDF("a", "na", "sa"), "a")
    met = met.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def check(batches):
        for b in batches:
            differ = [int(np.bitwise_count(np.bitwise_xor(*(fold(np.frombuffer(m, np.uint64)[None], min(len(x), len(y)) // 8)[0] for m in (x, y)))).sum()) for x, y in zip(b["sa"], b["sb"], strict=True)]
            keep = may_link(b["na"].to_numpy(), b["nb"].to_numpy(), np.array(differ, np.int64), percent)
            yield b.loc[keep, ["a", "b"]]

    return met.select("a", "b", "na", "nb", "sa", "sb").mapInPandas(check, "a long, b long")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, n_words: int, keep: Scratch) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the similarity, by intersection of sorted arrays. Texts are read again only for the classes in pairs."""
    need = keep.cut(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes, "cid").select("cid", "n", "key", "rep"))
    ids = need.select(F.col("rep").alias("id")).distinct()
    size = need.agg(F.count("*"), F.sum(F.octet_length(F.col("rep").cast("string")))).first()
    few = size[0] <= BROADCAST_ROWS and (size[1] or 0) < 20 * BROADCAST_ROWS

    def arrays(batches):
        for b in batches:
            found = [shingles(lowered(t), n_words) for t in b["text"]]
            yield pd.DataFrame({"n": [len(s) for s in found], "key": [digest(s) for s in found], "s": [s.tobytes() for s in found]})

    read = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInPandas(arrays, "n long, key binary, s binary")
    s = keep.cut(read.join(need.select("cid", "n", "key"), ["n", "key"]).groupBy("cid").agg(F.first("s").alias("s")))
    met = hub_join(pairs, s.toDF("b", "sb"), "b", "a").join(s.toDF("a", "sa"), "a")

    def check(batches):
        for b in batches:
            good = []
            for x, y in zip(b["sa"], b["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield b.loc[good, ["a", "b"]]

    return met.select("a", "b", "sa", "sb").mapInPandas(check, "a long, b long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80, n_words: int = 5) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union of their distinct n_words-shingles (words: runs of anything but ASCII white space, A-Z lower-cased).
    Null, empty or blank texts have 0 shingles and link with nothing. Repeated rows keep their rows, and rows that share an id may have different texts.
    Ids may be of any type that can be ordered. A row with a null id keeps its size, links with nothing and has a null component. Other columns are ignored."""
    with arrow_rows(df.sparkSession, TEXTS), planned_joins(df.sparkSession):
        return _jaccard_components(df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")), percent, n_words)


def _jaccard_components(docs: DataFrame, percent: int, n_words: int) -> DataFrame:
    keep = Scratch(docs.sparkSession)
    every = keep.cut(sets(docs, n_words))
    full = every.where("n > 0 and id is not null")
    classes = keep.cut(full.groupBy("n", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")).withColumn("cid", F.monotonically_increasing_id()))
    total = classes.agg(F.sum("n")).first()[0]
    if total is None:  # no text has a word
        keep.free(every)
        return every.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))

    one = prefixes(docs.where("id is not null"), percent, n_words, total).join(classes.select("n", "key", "cid", "sig"), ["n", "key"])
    cand = keep.cut(one.groupBy("cid", "n").agg(F.first("sig").alias("sig"), F.first("alone").alias("alone"), F.first("prefix").alias("prefix")))
    comp, links = None, None
    for turn in ("star", "tile"):
        known = cand.withColumn("comp", F.col("cid")) if comp is None else cand.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
        uses = known.select("cid", "comp", "n", "alone", F.explode("prefix").alias("token"))
        marks = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
        hub = F.min(F.struct("alone", "n", "cid", "comp")).alias("hub")
        live = uses.groupBy("token").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), hub, *marks).where("lo <> hi")
        live = keep.cut(live.dropDuplicates(["m", "mark1", "mark2", "hub"]).select("token", F.col("hub.cid").alias("b"), F.col("hub.comp").alias("hub_comp")))  # hashes with the same classes are one
        few = live.limit(BROADCAST_ROWS + 1).count()
        if few == 0:
            break
        met = uses.join(F.broadcast(live), "token") if few <= BROADCAST_ROWS else hub_join(uses, live, "token", "cid")
        if turn == "star":  # each class meets the hub that it shares most hashes with
            star = met.where("comp <> hub_comp").groupBy(F.col("cid").alias("a"), "b").agg(F.count("*").alias("k"))
            pairs = keep.cut(bounded(keep.cut(star.groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b"))), cand, percent))
        else:
            pairs = keep.cut(tile_pairs(met.select("token", "cid", "comp", "n").join(cand.select("cid", "sig"), "cid"), percent, keep))
        if pairs.isEmpty():
            continue
        more = keep.cut(verified(docs, classes, pairs, percent, n_words, keep))
        links = more if links is None else links.unionByName(more)
        comp = components(links)

    reps = classes.select("n", "key", "rep", "cid", "copies")
    if comp is None:
        named = reps.withColumn("component_id", F.col("rep"))
    else:
        inside = keep.cut(reps.join(comp.withColumnRenamed("node", "cid"), "cid"))
        least = inside.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = reps.join(inside.select("cid", "component").join(least, "component").drop("component"), "cid", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    named = keep.cut(named.where("copies > 1 or component_id <> rep").select("n", "key", "component_id", "copies"))
    keep.free(every, named)
    return hub_named(every, named)


def hub_named(every: DataFrame, named: DataFrame, copies: int = 1000) -> DataFrame:
    """every's rows with the component of their class, or their own id. Rows without shingles meet nothing; classes of more than `copies` rows, or of more than one in BROADCAST_ROWS
    of all, so that there are at most BROADCAST_ROWS of these, are met by broadcast; only rows of the others are dealt by class."""
    large = F.col("copies") > max(copies, every.count() // BROADCAST_ROWS)
    busy, calm = named.where(large).select("n", "key", F.col("component_id").alias("busy")), named.where(~large).drop("copies")
    full = (F.col("n") > 0) & F.col("id").isNotNull()
    rows = every.select("id", "n", "key")
    marked = rows.where(full).join(F.broadcast(busy), ["n", "key"], "left")
    met = marked.where("busy is null").drop("busy").join(calm, ["n", "key"], "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    out = met.unionByName(marked.where("busy is not null").select("id", "n", F.col("busy").alias("component_id"))).unionByName(rows.where(~full).select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
