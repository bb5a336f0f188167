"""SimHash near-dedup with vantage-point trees.

A fingerprint takes the majority of each bit over the XXH64 (seed 42) of all word
shingles of a whole text. Links (Hamming distance <= radius) are found among distinct
fingerprints, so a group of copies is one point. A top tree over a bounded sample splits
the space into shards at vantage points; a fingerprint has one home shard and visits
each shard whose region lies within the radius of it (triangle bound). In a shard the
search goes on by further vantage points until few points are left, so every linked pair
is found exactly, at the home of one of them; it is merged into shard-local groups, not
listed. Components of the whole come from star contraction over (point, local root).

Null text is empty; a text without words has fingerprint zero and links like any other;
fewer words than a shingle give one shingle of all words. Repeated rows are one point
and null ids never become a component id unless all ids of it are null. Texts are read
whole, of any length; a bit that is set in exactly half the hashes is 0. Empty tables give
empty results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import ascii_lower, keep, words
from quillstone.llm.graph import components

#: Fingerprints drawn for the top tree, points that a shard should be home to, and shards that small inputs are dealt to as well.
SAMPLE = 50_000
SHARD = 100_000
SPREAD = 12
LEAF = 96
#: Shingle hashes held as single bits at a time.
CHUNK = 1 << 17


def shingles(w: Column, size: int) -> Column:
    """Shingles of an array of words, repeats included; fewer words give the whole sequence."""
    joined = lambda xs: F.array_join(xs, " ")
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: joined(F.slice(w, i, size)))
    return F.when(F.size(w) >= size, many).when(F.size(w) > 0, F.array(joined(w))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(_id, hashes): XXH64 with seed 42 of every shingle, made in the JVM."""
    tokens = docs.select(F.col(id_col).alias("_id"), words(ascii_lower(F.col(text_col))).alias("_w"))
    return tokens.select("_id", F.transform(shingles(F.col("_w"), size), lambda s: F.xxhash64(s)).alias("hashes"))


def lists_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row starts (one more than rows) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts = np.asarray(column.offsets, dtype=np.int64)
    values = np.asarray(column.values)[starts[0] : starts[-1]]
    return values, starts - starts[0]


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a list column has about so many values in each, or one row."""
    for batch in batches:
        starts = np.asarray(batch.column(column).offsets, dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def majority(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The majority fingerprint of each row's hashes; zero for a row without any."""
    rows = len(starts) - 1
    counts = np.zeros((rows, 64), np.int64)
    owner = np.repeat(np.arange(rows), np.diff(starts))
    for a in range(0, len(values), CHUNK):
        part, own = values[a : a + CHUNK], owner[a : a + CHUNK]
        bits = np.unpackbits(part.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    bits = (2 * counts > np.diff(starts)[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(-1)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        values, starts = lists_of(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority(values, starts), pa.int64())], ["_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(_id, fp long) for every row."""
    hashed = shingle_hashes(docs, id_col, text_col, size)
    kind = docs.schema[id_col].dataType.simpleString()
    return hashed.mapInArrow(_fingerprint_batches, f"_id {kind}, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    """Differing bits; counted unsigned, as the count of a negative number is that of its absolute value."""
    return np.bitwise_count((np.asarray(a, np.int64) ^ np.asarray(b, np.int64)).view(np.uint64))


class Tree:
    """Vantage points over a sample: inner nodes (vantage, mu, near, far); a leaf is ~shard."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int, seed: int = 11):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.shards = 0
        self.radius = radius
        self.root = self._grow(np.unique(sample), max(1, leaves), np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, leaves: int, rng) -> int:
        split = best_split(points, self.radius, rng) if leaves > 1 and len(points) > 3 else None
        drawn = split is None and leaves > 1
        if drawn:
            # The sample is used up: a drawn vantage point with half of all fingerprints within 31 bits goes on from there.
            vantage = rng.integers(-(1 << 63), 1 << 63)
            split = vantage, 31, distance(points, vantage) <= 31
        if split is None:
            self.shards += 1
            return ~(self.shards - 1)
        vantage, mu, near = split
        at = len(self.nodes)
        self.nodes.append(())
        half = max(1, round(leaves * (0.5 if drawn else near.mean())))
        left, right = self._grow(points[near], half, rng), self._grow(points[~near], max(1, leaves - half), rng)
        self.nodes[at] = (int(vantage), mu, left, right)
        return at

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of point, shard, home): each point's home shard and the shards that it visits."""
        out, todo = [], [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, np.full(len(rows), ~node, np.int32), home))
                continue
            vantage, mu, left, right = self.nodes[node]
            d = distance(points[rows], np.int64(vantage)).astype(np.int16)
            near, far = d - self.radius <= mu, d + self.radius > mu
            todo += [(left, rows[near], home[near] & (d[near] <= mu)), (right, rows[far], home[far] & (d[far] > mu))]
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_split(points: np.ndarray, radius: int, rng) -> tuple | None:
    """The vantage point and distance, of a few tried, that leave the fewest points at the boundary of an even split."""
    best = None
    for vantage in rng.choice(points, min(6, len(points)), replace=False):
        d = distance(points, vantage)
        below = np.cumsum(np.bincount(d, minlength=65))
        n = len(points)
        for mu in range(64):
            if 0.3 * n <= below[mu] <= 0.7 * n:
                border = below[min(64, mu + radius)] - (below[mu - radius] if mu >= radius else 0)
                cost = (border / n, abs(below[mu] / n - 0.5))
                if best is None or cost < best[0]:
                    best = (cost, vantage, mu, d <= mu)
    if best is None:  # many points at one distance: any cut that divides them
        d = distance(points, points[0])
        mu = int(np.median(d))
        mu = mu if (d > mu).any() else int(d.min())
        return (points[0], mu, d <= mu) if (d > mu).any() else None
    return best[1:]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of each a[i], b[i]; label[x] is then the least index of x's group."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def local_groups(points: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Least index of each point's group under all links between a home point and any point."""
    label = np.arange(len(points))
    rng = np.random.default_rng(5)
    todo = [(np.flatnonzero(home), np.arange(len(points)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        split = None
        if len(p) > LEAF:
            split = best_split(points[p], radius, rng)
        if split is None:
            step = max(1, (1 << 22) // len(p))
            for a in range(0, len(q), step):
                part = q[a : a + step]
                i, j = np.nonzero(distance(points[part][:, None], points[p][None, :]) <= radius)
                i, j = part[i], p[j]
                merge(label, i[i != j], j[i != j])
            continue
        vantage, mu, near = split
        d = distance(points[q], vantage).astype(np.int16)
        todo += [(p[near], q[d - radius <= mu]), (p[~near], q[d + radius > mu])]
    return label


def link_fingerprints(points: DataFrame, radius: int = 2, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """points(fp), distinct -> (u, v): links that have the components of all pairs within radius."""
    spark = points.sparkSession
    n = points.count()
    if not n:
        return spark.createDataFrame([], "u long, v long")
    # The top tree only deals out work; its sample is bounded and has no part in which pairs are found.
    drawn = points.orderBy(F.xxhash64("fp", F.lit(3))).limit(sample).toPandas()["fp"].to_numpy(np.int64)
    # Every level of the tree sends some points to both sides, so shards are few and large; a shard goes on by its own tree.
    tree = Tree(drawn, max(-(-n // shard), min(SPREAD, -(-5 * n // shard))), radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            rows, shards, home = tree.deal(fps)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(fps[rows], pa.int64()), pa.array(home)], ["shard", "fp", "home"])

    def solve(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy()
        order = np.argsort(fps)
        fps, home = fps[order], group.column("home").to_numpy()[order]
        root = local_groups(fps, home, radius)
        moved = root != np.arange(len(fps))
        return pa.table({"u": fps[moved], "v": fps[root[moved]]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    dealt = points.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(solve, "u long, v long").distinct()


def group_prints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """prints(_id, fp), read more than once -> with component_id: the smallest id reachable over links within radius."""
    points = keep(prints.groupBy("fp").agg(F.min("_id").alias("_least")), "points")
    found = components(keep(link_fingerprints(points.select("fp"), radius), "links"))
    placed = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    placed = placed.join(least, "root").select("fp", "component_id")
    return prints.join(placed, "fp").select("_id", "fp", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp long, component_id) for every row."""
    prints = keep(fingerprints(docs, id_col, text_col, size), "prints")
    return group_prints(prints, radius).withColumnRenamed("_id", id_col)


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
