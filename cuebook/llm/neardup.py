"""Operator 1: embedding near-duplicates by dual traversal of cover trees, exact at the threshold.

Equal vectors of a label are one. The rest are spread over groups of bounded size by label and nearest pivot, so that a group is compact. Groups of one
label whose covering balls are nearer than the threshold distance meet in one task, which builds a cover tree of each (nested nets with halving radii),
walks both trees together, drops node pairs whose balls are too far apart, and compares single vectors in double precision.
A pair of groups returns link counts and a spanning star per local component, never all pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebook.llm.common import Scratch, components, hub_join

#: Vectors of a block (one row of the shuffle), blocks of a group, rows of a node that isn't split further, and rows of a distance matrix made at once.
BLOCK, BLOCKS, LEAF, STRIP = 1024, 8, 32, 512
FINE = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe from overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit rows, good to about 1e-7."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def net(x: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, owner, distance): rows more than spacing apart, the first row among them, such that every row lies within spacing of one; each row goes to the nearest."""
    near, owner, centres = np.full(len(x), np.inf), np.zeros(len(x), np.int64), []
    at = 0
    while at < len(x):
        some = at + np.flatnonzero(near[at : at + STRIP] > spacing)
        at += STRIP
        inner, fresh = apart(x[some], x[some]), []
        for k in range(len(some)):
            if not fresh or inner[k, fresh].min() > spacing:
                fresh.append(k)
        if not fresh:
            continue
        picked = some[fresh]
        for lo in range(0, len(x), 4 * STRIP):
            d = apart(x[lo : lo + 4 * STRIP], x[picked])
            least, best = d.min(axis=1), d.argmin(axis=1)
            closer = least < near[lo : lo + 4 * STRIP]
            near[lo : lo + 4 * STRIP][closer] = least[closer]
            owner[lo : lo + 4 * STRIP][closer] = len(centres) + best[closer]
        centres += picked.tolist()
    centres = np.array(centres)
    near[centres], owner[centres] = 0.0, np.arange(len(centres))
    return centres, owner, near


class Node:
    """A ball of rows. heads are the centres of its children, radii their covering radii, kids the children that are no single rows."""

    __slots__ = ("rows", "radius", "heads", "radii", "kids")

    def __init__(self, rows: np.ndarray, x: np.ndarray, scale: float):
        """Children are a net of half the scale, which the first row begins; scales that the first row covers alone are passed over."""
        self.rows = rows
        far = apart(x[rows], x[rows[:1]])[:, 0]
        self.radius = float(far.max()) + 1e-7
        while scale / 2 >= self.radius:
            scale /= 2
        if len(rows) <= LEAF or scale < 1e-6:
            self.heads, self.radii, self.kids = rows, np.zeros(len(rows)), {}
            return
        centres, owner, _ = net(x[rows], scale / 2)
        order = owner.argsort(kind="stable")
        edge = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        self.heads, self.radii, self.kids = rows[centres], np.zeros(len(centres)), {}
        for k in np.flatnonzero(np.diff(edge) > 1):
            mine = order[edge[k] : edge[k + 1]]
            mine = np.r_[centres[k], mine[mine != centres[k]]]
            self.kids[int(k)] = kid = Node(rows[mine], x, scale / 2)
            self.radii[k] = kid.radius

    def some(self, at: np.ndarray):
        """A node of the given children, those that are no single rows one level down."""
        out = Node.__new__(Node)
        plain = at[self.radii[at] == 0]
        heads, radii, kids, n = [self.heads[plain]], [np.zeros(len(plain))], {}, len(plain)
        for k in at[self.radii[at] > 0].tolist():
            kid = self.kids[k]
            heads.append(kid.heads)
            radii.append(kid.radii)
            kids.update((n + i, x) for i, x in kid.kids.items())
            n += len(kid.heads)
        out.heads, out.radii, out.kids = np.concatenate(heads), np.concatenate(radii), kids
        return out


class Links:
    """Link counts and components of rows."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.up = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def roots(self, rows: np.ndarray) -> np.ndarray:
        top = self.up[rows]
        while True:
            more = self.up[top]
            if (more == top).all():
                return top
            top = more

    def add(self, r: np.ndarray, s: np.ndarray, near: np.ndarray, both: bool) -> None:
        """Links of the rows r with the rows s where near; both: count them for s too."""
        i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(i):
            return
        r, s, near = r[i], s[j], near[np.ix_(i, j)]
        self.count[r] += near @ self.weight[s]
        if both:
            self.count[s] += self.weight[r] @ near
        one, two = self.roots(r), self.roots(s)
        low, high = one.copy(), two.copy()
        top = np.iinfo(np.int64).max
        if near.all():
            low[:] = high[:] = min(low.min(), high.min())
        while not near.all():  # smallest root of each local component
            new = np.minimum(low, np.where(near, high[None], top).min(axis=1))
            other = np.minimum(high, np.where(near, new[:, None], top).min(axis=0))
            if (new == low).all() and (other == high).all():
                break
            low, high = new, other
        for a, b in np.unique(np.c_[np.r_[one, two], np.r_[low, high]], axis=0).tolist():
            while self.up[a] != a:
                a = int(self.up[a])
            while self.up[b] != b:
                b = int(self.up[b])
            self.up[max(a, b)] = min(a, b)


def traverse(p: Node, q: Node, x: np.ndarray, threshold: float, found: Links) -> None:
    """Walk two trees (or one with itself) and add every link between their rows once."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    stack = [(p, q)]
    while stack:
        a, b = stack.pop()
        for lo in range(0, len(a.heads), STRIP):
            r = a.heads[lo : lo + STRIP]
            g = x[r] @ x[b.heads].T
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * g))
            meet = d <= a.radii[lo : lo + STRIP, None] + b.radii[None] + reach
            if a is b:
                meet &= np.arange(len(b.heads))[None] >= (lo + np.arange(len(r)))[:, None]
            plain = (a.radii[lo : lo + STRIP, None] == 0) & (b.radii[None] == 0)
            near = meet & plain & (g >= threshold)
            if a is b:
                near &= r[:, None] != b.heads[None]
            found.add(r, b.heads, near, True)
            rest = meet & ~plain
            with_kids = a.radii[lo : lo + STRIP] > 0
            if a is b:
                for i in np.flatnonzero(with_kids).tolist():
                    stack.append((a.kids[lo + i], a.kids[lo + i]))
                    rest[i, lo + i] = False
            stack += [(a.kids[lo + i], b.some(np.flatnonzero(rest[i]))) for i in np.flatnonzero(with_kids & rest.any(axis=1)).tolist()]
            rest &= ~with_kids[:, None]
            stack += [(b.kids[j], a.some(lo + np.flatnonzero(rest[:, j]))) for j in np.flatnonzero(rest.any(axis=0)).tolist()]


def links(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, size: int, threshold: float):
    """(id, links found here, local root id) for every row with a link. The first size rows are one group and the others, if any, its partner."""
    found = Links(weight)
    one = Node(np.arange(size), x, 2.0)
    two = one if size == len(x) else Node(np.arange(size, len(x)), x, 2.0)
    traverse(one, two, x, threshold, found)
    hit = np.flatnonzero(found.count)
    top = found.roots(hit)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, top, ids[hit])
    return ids[hit], found.count[hit], least[top]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, pivots: int = 64) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when labels are equal and not null and their cosine reaches the threshold (above 0). Vectors that are null, zero or hold null or non-finite
    components link with nothing, and keep a row with 0 links; so do rows with a null id or label. Ids must be integers; rows that repeat an id count as separate
    vectors for n_links and share the smaller component. Vectors of different lengths are compared only within equal length. Other columns are ignored.
    pivots: size of the bounded sample of vectors that only decides the layout."""
    spark = df.sparkSession
    keep = Scratch(spark)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    able = F.expr(FINE) & F.col("label").isNotNull() & F.col("id").isNotNull()
    key = F.when(able, F.concat_ws(":", F.hex(F.xxhash64("v", F.lit(1))), F.hex(F.xxhash64("v", F.lit(2))), F.size("v").cast("string"), "label"))
    base = base.withColumn("key", key)
    good = keep.cut(base.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("cid", F.monotonically_increasing_id()))
    sample = [r.v for r in good.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(pivots).collect()]
    if not sample:  # no vector can link
        keep.free()
        return base.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    size = max(len(v) for v in sample)
    pivot = unit(np.array([v for v in sample if len(v) == size]))

    def place(batches):
        for b in batches:
            dims = b["v"].map(len).to_numpy()
            cell, dist = np.zeros(len(b), np.int64), np.zeros(len(b))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = unit(np.array([b["v"].iloc[i] for i in at], float))
                if d == size:
                    s = x @ pivot.T
                    cell[at], dist[at] = s.argmax(axis=1), s.max(axis=1)
            yield pd.DataFrame({"label": b["label"] + "/" + dims.astype(str), "cell": cell, "dist": dist, "cid": b["cid"], "copies": b["copies"], "v": b["v"]})

    placed = good.select("label", "cid", "copies", "v").mapInPandas(place, "label string, cell long, dist double, cid long, copies long, v array<double>")
    ordered = placed.repartitionByRange("label", "cell", "dist", F.xxhash64("cid")).sortWithinPartitions("label", "cell", "dist", "cid")

    def pack(batches):
        from pyspark import TaskContext

        group, name, blocks, rows = TaskContext.get().partitionId() << 32, None, 0, []

        def block():
            x = unit(np.array([r[2] for r in rows], float))
            c = unit(x.mean(axis=0, keepdims=True) + 1e-12)[0]
            radius = float(np.sqrt(((x - c) ** 2).sum(axis=1)).max())
            return {"label": name, "group": group, "block": blocks, "centre": c, "radius": radius, "ids": np.array([r[0] for r in rows], np.int64).tobytes(), "weight": np.array([r[1] for r in rows], np.int64).tobytes(), "x": x.tobytes(), "dim": x.shape[1]}

        for b in batches:
            out = []
            for row in zip(b["label"], b["cid"], b["copies"], b["v"], strict=True):
                if rows and (row[0] != name or len(rows) == BLOCK):
                    out.append(block())
                    blocks, rows = blocks + 1, []
                    if row[0] != name or blocks == BLOCKS:
                        group, blocks = group + 1, 0
                name = row[0]
                rows.append(row[1:])
            if out:
                yield pd.DataFrame(out)
        if rows:
            yield pd.DataFrame([block()])

    schema = "label string, group long, block int, centre array<double>, radius double, ids binary, weight binary, x binary, dim int"
    blocks = keep.cut(ordered.select("label", "cid", "copies", "v").mapInPandas(pack, schema))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    head = blocks.groupBy("label", "group").agg(F.collect_list(F.struct("centre", "radius")).alias("balls"))  # BLOCKS at most
    gap = lambda s, t: F.sqrt(F.aggregate(F.zip_with(s["centre"], t["centre"], lambda m, n: (m - n) * (m - n)), F.lit(0.0), lambda m, n: m + n)) - s["radius"] - t["radius"]
    close = F.exists("balls_a", lambda s: F.exists("balls_b", lambda t: gap(s, t) <= reach))
    pairs = head.toDF("label", "a", "balls_a").join(head.toDF("label", "b", "balls_b"), "label").where((F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) & close)).select("a", "b")
    pairs = keep.cut(pairs.withColumn("pair", F.monotonically_increasing_id()))
    sides = pairs.select("pair", F.col("a").alias("group"), F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select("pair", F.col("b").alias("group"), F.lit(1).alias("side")))
    met = sides.join(blocks.select("group", "block", "ids", "weight", "x", "dim"), "group")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["side", "block"])
        ids, weight = (np.concatenate([np.frombuffer(z, np.int64) for z in g[c]]) for c in ("ids", "weight"))
        x = np.concatenate([np.frombuffer(z, float) for z in g["x"]]).reshape(-1, int(g["dim"].iloc[0]))
        one = sum(len(z) // 8 for z, s in zip(g["ids"], g["side"], strict=True) if s == 0)
        got, n, root = links(ids, weight, x, one, threshold)
        return pd.DataFrame({"cid": got, "n": n, "root": root})

    found = keep.cut(met.groupBy("pair").applyInPandas(compare, "cid long, n long, root long"))
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    group = components(found, "cid", "root").withColumnRenamed("node", "cid")
    each = keep.cut(good.select("key", "cid", "id", "copies").join(counts, "cid", "left").join(group, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    least = each.groupBy("component").agg(F.min("id").alias("component_id"))
    named = keep.cut(each.join(least, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id"))
    rows = base.select("id", "key")
    out = hub_join(rows.where("key is not null"), named, "key", "id").select("id", "n", "component_id")
    out = out.unionByName(rows.where("key is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component_id")))
    keep.free(named)
    return out.select(F.col("id").alias("vec_id"), F.col("n").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(False)).alias("kept"))
