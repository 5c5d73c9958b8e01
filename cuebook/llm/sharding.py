"""Operator 11: shards of near equal bytes by histogram sort, in DataFrame functions only.

Rows are ordered by a key of three numbers: a hash of the text, a hash of the id, and the row's place, so that equal texts are neighbours. A splitter is sought between
two probes: a round counts, over all partitions, the exact bytes in equal cells of every open interval; a splitter stops at a cell's edge that meets the tolerance, else its
cell is the next interval. So a group of equal texts is cut only where none of its edges will do. Once all splitters stand, the rows are exchanged once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebook.llm.common import BROADCAST_ROWS, Scratch

#: Numbers of the key and their bits.
KEY = (("h", 60), ("r", 60), ("u", 63))
#: Bits that a round reads of a number, the first time and later: at most 4,096 cells a splitter.
FIRST, STEP = 12, 10


def first_bits(text: Column) -> Column:
    """The first 60 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame, id_col: str, text: str, carry: bool) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = [F.struct("*").alias("row")] if carry else []
    d = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), first_bits(t).alias("h"), *own)
    return d.withColumn("r", first_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("u", F.monotonically_increasing_id())


def splitters(keys: DataFrame, shards: int, parts: int) -> list[tuple[int, int, int]]:
    """The smallest keys of the shards from the second on; each has below it its share of the bytes, but for one of `parts` of a shard or, if no edge is so near, half a row."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    off = lambda k, below: abs(below * shards - k * total)
    pending = {k: ((), KEY[0][1], 0, 0) for k in range(1, shards)} if total else {}  # numbers known, shift, cell, bytes below
    found = {k: (0, 0, 0) for k in range(1, shards)}
    while pending:
        spans = sorted({p[:3] for p in pending.values()})
        nexts, cell = [], None
        for i, (known, shift, at) in enumerate(spans):
            name, bits = KEY[len(known)]
            nexts.append(max(0, shift - (FIRST if shift == bits else STEP)))
            inside = F.shiftright(name, shift) == at
            for (n, _), value in zip(KEY, known, strict=False):
                inside = (F.col(n) == value) & inside
            here = F.struct(F.lit(i).alias("span"), F.shiftright(name, nexts[i]).alias("cell"), F.col(name).alias("value"))
            cell = F.when(inside, here) if cell is None else cell.when(inside, here)
        counts = keys.select("size", cell.alias("c")).where("c is not null").groupBy("c.span", "c.cell")
        rows = counts.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("c.value").alias("low"), F.max("c.value").alias("high")).collect()
        cells = {i: sorted((r for r in rows if r.span == i), key=lambda r: r.cell) for i in range(len(spans))}
        for k, (known, shift, at, below) in list(pending.items()):
            i = spans.index((known, shift, at))
            for c in cells[i]:
                if (below + c.bytes) * shards > k * total:
                    break
                below += c.bytes
            edges = [(off(k, below), c.cell << nexts[i]), (off(k, below + c.bytes), min((c.cell + 1) << nexts[i], 2**63 - 1))]
            near = min(edges, key=lambda e: e[0])
            single = c.low == c.high
            if near[0] * parts <= total or c.n == 1 or (single and len(known) + 1 == len(KEY)):
                found[k] = ((*known, near[1]) + (0, 0))[: len(KEY)]
                del pending[k]
            else:
                pending[k] = ((*known, c.low), KEY[len(known) + 1][1], 0, below) if single else (known, nexts[i], c.cell, below)
    return [found[k] for k in range(1, shards)]


def at_or_after(key: tuple[int, int, int]) -> Column:
    h, r, u = key
    return (F.col("h") > h) | ((F.col("h") == h) & ((F.col("r") > r) | ((F.col("r") == r) & (F.col("u") >= u))))


def sharded(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text", parts: int = 1000, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and with carry the whole row as `row`.

    size is the text's UTF-8 bytes plus 1 (null: 1). Shards' sizes are near equal (law `bytes`): each splitter is off by one of `parts` of a shard, or else by half a row or
    less. Equal texts are neighbours, in one shard but where a group holds more than the tolerance about a splitter. slot is the place (from 0) in the shard, in order
    of the key. Null texts count as empty; null ids, repeated rows and copies of any number are cut like others; an empty table gives no rows. Other columns, whatever their
    names, come along in `row` only. Keys, and rows with carry, are written once in the shared folder, so that retries and rounds read the same ones."""
    keep = Scratch(docs.sparkSession)
    keys = keep.cut(keyed(docs, id_col, text, carry))
    shard = F.lit(0)
    for key in splitters(keys.select("size", "h", "r", "u"), shards, parts):
        shard = shard + at_or_after(key).cast("int")
    order = ["shard", "h", "r", "u"]
    dealt = keys.withColumn("shard", shard).repartitionByRange(*order).sortWithinPartitions(*order)
    own = ["row"] if carry else []
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = keep.cut(dealt.select("doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("part"), at.alias("at"), *own))
    keep.free(placed)
    return slotted(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *own)


def slotted(placed: DataFrame) -> DataFrame:
    """placed (shard, part, at) with slot: parts hold the order, so that counts of a part's rows in a shard, a row each, are all that is summed."""
    spark = placed.sparkSession
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.expr("coalesce(sum(n) over (partition by shard order by part rows between unbounded preceding and 1 preceding), 0)")
    starts = Scratch(spark).cut(counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), (before - F.col("first")).alias("shift")))
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    met = placed.join(starts, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return met.withColumn("slot", F.col("at") + F.col("shift"))


def written(docs: DataFrame, folder: str, shards: int = 16, id_col: str = "doc_id", text: str = "text") -> None:
    """The documents' rows in folders shard=0 and so on, with shard and slot; columns of these names give way."""
    out = sharded(docs, shards, id_col, text, carry=True)
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    out.select(*[F.col("row")[c].alias(c) for c in names], "slot", "shard").write.partitionBy("shard").parquet(folder)
