"""Hard negatives by k-means inverted lists with centroid radii, exact.

Centroids are fitted on a bounded sample; every vector is then put into the list of its
nearest centroid, and each list keeps its radius r (the largest distance of a member). By
Cauchy-Schwarz an anchor a scores within a.c +- |a| r with every member, so

1. each anchor visits the FIRST lists of largest bound, which gives its kth score,
2. and then every other list unless its bound falls strictly below that kth score.

So it goes twice: for the positives (rows of the anchor's label), then for the negatives of
each positive's window, where lists wholly outside of all windows are skipped and each window
has a kth score of its own. Rows with the kth score itself are still visited, so ties are
exact; recall is 1 whatever the centroids are.

Lists are cut into pieces of about PIECE rows and pieces into groups of GROUP, so a list of any
size (a third of all vectors may be one vector) is dealt to many tasks; an anchor is sent
to a group as one row of a pack, tasks keep only the best few rows an anchor. Broadcast are the
centroids and radii alone: CENTROIDS vectors at most.

Rows without a label or vector, or with a null or non-finite component, take no part.
Components are scaled and floored to whole numbers, of 2**26 in size at most (larger ones count as
that), so scores are exact longs. Shorter vectors count as filled up with zeros; an empty vector
scores zero with all. Ties go by the smaller id; a null id stands behind all others (as 2**63-1) and comes back
null. Repeated rows are rows of their own: an anchor's copies are among its other rows, and
each copy of an anchor is an anchor. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import keep

#: Vectors drawn for the centroids, centroids at most, and rounds of fitting.
SAMPLE, CENTROIDS, ROUNDS = 20_000, 1024, 6
#: Rows of a piece on average, pieces of a group, anchors of a pack, and lists that are visited before any is skipped.
PIECE, GROUP, PACK, FIRST = 512, 16, 256, 4
#: Largest size of a whole component; 64 products of two such stay below 2**63, longer vectors have smaller ones.
LARGEST = 1 << 26
NO_ID = (1 << 63) - 1
#: Candidates a task gathers before it reduces them to the best few an anchor.
GATHER = 400_000


def whole(vector: Column, scale: int) -> Column:
    """Components as whole numbers: floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))


def usable(label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of float64, filled up with zeros."""
    starts = np.asarray(column.offsets, np.int64)
    flat = np.asarray(column.values)[starts[0] : starts[-1]].astype(np.float64)
    lens = np.diff(starts)
    if (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), width))
    out[np.arange(width)[None, :] < lens[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as float64."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    return (a @ b.T).astype(np.int64) if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def fit(sample: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Centroids of distinct sample rows by Lloyd's rounds; a centroid without rows goes."""
    points = np.unique(sample, axis=0)
    centroids = points[np.sort(np.random.default_rng(seed).permutation(len(points))[:k])]
    for _ in range(ROUNDS):
        own = nearest(sample, centroids)[0]
        count = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = sums[count > 0] / count[count > 0][:, None]
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's centroid and its distance."""
    own = np.empty(len(points), np.int64)
    for a in range(0, len(points), 4096):
        own[a : a + 4096] = ((centroids**2).sum(axis=1)[None, :] - 2 * points[a : a + 4096] @ centroids.T).argmin(axis=1)
    return own, np.sqrt(((points - centroids[own]) ** 2).sum(axis=1))


class Lists:
    """Centroids and radii of the inverted lists, and in how many groups of pieces each is."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray, groups: np.ndarray):
        self.centroids, self.radii, self.groups = centroids, radii, groups

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that a member of each list can have with each anchor, a little wider for rounding."""
        middle = anchors @ self.centroids.T
        spread = np.sqrt((anchors**2).sum(axis=1))[:, None] * self.radii[None, :]
        slack = 1e-3 + 1e-9 * (np.abs(middle) + spread)
        return middle - spread - slack, middle + spread + slack


def first_lists(top: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Marks each row's FIRST open lists of largest bound."""
    order = np.argsort(np.where(open_, -top, np.inf), axis=1, kind="stable")[:, :FIRST]
    out = np.zeros_like(open_)
    np.put_along_axis(out, order, True, axis=1)
    return out & open_


def best_rows(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Indices of each (anchor, slot)'s best rows: larger score, then smaller id."""
    order = np.lexsort((ids, -score, slot, anchor))
    new = np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (slot[order][1:] != slot[order][:-1])] if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    return order[np.arange(len(order)) - start < most]


HIT = "anchor long, slot int, score long, id long"
_hit = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
#: An anchor, the range of scores that each of its slots still looks for, and the slots' ranges as they were at first.
ANCHOR = "anchor long, label long, q array<int>, low array<long>, high array<long>, floor array<long>"


def _packs(lists: Lists, width: int, later: bool):
    """Anchors -> one row per list group that they visit: first the FIRST lists, later all others that can still matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 2048):
                batch = whole_batch.slice(at, 2048)
                bottom, top = lists.bounds(matrix(batch.column("q"), width))
                slots = len(batch.column("low")[0])
                low, high, floor = (np.asarray(batch.column(c).flatten()).reshape(-1, slots) for c in ("low", "high", "floor"))
                reach = lambda least: np.logical_or.reduce([(top >= least[:, [j]]) & (bottom <= high[:, [j]]) & (least[:, [j]] <= high[:, [j]]) for j in range(slots)])
                visit = first_lists(top, reach(floor))
                if later:
                    visit = reach(low) & ~visit
                for c in np.flatnonzero(visit.any(axis=0)):
                    who = np.flatnonzero(visit[:, c])
                    for a in range(0, len(who), PACK):
                        part = pa.Table.from_batches([batch.take(pa.array(who[a : a + PACK]))]).combine_chunks()
                        n = int(lists.groups[c])
                        columns = [part.column(x).chunk(0) if part.column(x).num_chunks else pa.array([], part.schema.field(x).type) for x in ("anchor", "label", "q", "low", "high")]
                        one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns]
                        repeated = [pa.concat_arrays([x] * n) for x in one]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *repeated], ["list", "group", "a_anchor", "a_label", "a_q", "a_low", "a_high"])

    return run, "list int, group int, a_anchor array<long>, a_label array<long>, a_q array<array<int>>, a_low array<array<long>>, a_high array<array<long>>"


def _score(width: int, same: bool, most: int):
    """Packs beside pieces -> the best rows of each anchor and slot that one task sees."""

    def pair(row: int, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        cell = lambda name: batch.column(name)[row].values
        anchors, labels = np.asarray(cell("a_anchor")), np.asarray(cell("a_label"))
        keys, theirs, ids = (np.asarray(cell(c)) for c in ("row", "label", "id"))
        scores = products(matrix(cell("a_q"), width), matrix(cell("q"), width))
        alike = labels[:, None] == theirs[None, :]
        fits = alike & (anchors[:, None] != keys[None, :]) if same else ~alike
        slots = len(cell("a_low")[0])
        low, high = (np.asarray(cell(c).flatten()).reshape(-1, slots) for c in ("a_low", "a_high"))
        out = []
        for j in range(slots):
            ok = fits & (scores >= low[:, [j]]) & (scores <= high[:, [j]])
            over = ok.sum(axis=1) > most
            if over.any():  # none below the best few of a piece can be among the best few of all
                held = np.where(ok[over], scores[over], np.iinfo(np.int64).min)
                ok[over] &= scores[over] >= np.partition(held, held.shape[1] - most, axis=1)[:, [held.shape[1] - most]]
            i, k = np.nonzero(ok)
            out.append((anchors[i], np.full(len(i), j, np.int32), scores[i, k], ids[k]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def reduced() -> tuple[np.ndarray, ...]:
            every = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            keep_ = best_rows(*every, most)
            return tuple(x[keep_] for x in every)

        for batch in batches:
            for row in range(batch.num_rows):
                found = pair(row, batch)
                held.append(found)
                n += len(found[0])
                if n > GATHER:
                    held = [reduced()]
                    n = len(held[0][0])
                    if n > GATHER // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], schema=_hit)
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in reduced()], schema=_hit)

    return run


def _best(hits: DataFrame, most: int) -> DataFrame:
    """The best hits of each (anchor, slot), with their rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def search(anchors: DataFrame, pieces: DataFrame, lists: Lists, width: int, same: bool, most: int) -> DataFrame:
    """(anchor, slot, score, id, rank): the best rows of each slot whose scores lie in its range. anchors: as ANCHOR, kept; low = floor."""

    def visit(of: DataFrame, later: bool) -> DataFrame:
        run, schema = _packs(lists, width, later)
        packs = of.mapInArrow(run, schema)
        # Packs are many times their anchors, by whose size Spark would judge them: never broadcast.
        return packs.join(pieces.hint("merge"), ["list", "group"]).mapInArrow(_score(width, same, most), HIT)

    hits = keep(_best(visit(anchors, False), most).drop("rank"), "hits")
    # From here on a slot looks only for what reaches its kth score.
    kth = hits.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= most)
    kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("_kth"))
    raised = F.transform("low", lambda x, j: F.greatest(x, F.coalesce(F.element_at("_kth", j), x)))
    narrowed = anchors.join(kth, "anchor", "left").withColumn("low", raised).drop("_kth")
    return _best(hits.unionByName(visit(narrowed, True)), most)


def build(rows: DataFrame) -> tuple[DataFrame, Lists, int]:
    """Kept rows(row, id, label, q) -> pieces(list, group, row, id, label, q), each of arrays; the lists; the width of vectors."""
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    width = max(1, size["width"] or 1)
    drawn = rows.orderBy(F.xxhash64("q", "id"), "row").limit(SAMPLE).select("q").toPandas()["q"]
    sample = np.zeros((len(drawn), width))
    for i, q in enumerate(drawn):
        sample[i, : len(q)] = q
    centroids = fit(sample, int(min(CENTROIDS, max(1, size["n"] ** 0.5))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = nearest(matrix(batch.column("q"), width), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], ["row", "id", "label", "q", "list", "far"])

    placed = keep(rows.select("row", "id", "label", "q").mapInArrow(assign, "row long, id long, label long, q array<int>, list int, far double"), "placed")
    stats = {r["list"]: r for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()}
    found = [stats.get(c) for c in range(len(centroids))]
    counts = np.array([s["n"] if s else 0 for s in found])
    n_pieces = np.maximum(1, -(-counts // PIECE))
    lists = Lists(centroids, np.array([s["r"] if s else 0.0 for s in found]) * (1 + 1e-9), np.where(counts > 0, -(-n_pieces // GROUP), 0))
    cut = spark.createDataFrame([(c, int(n)) for c, n in enumerate(n_pieces) if counts[c]], "list int, _pieces int")
    dealt = placed.join(F.broadcast(cut), "list").withColumn("_piece", F.pmod(F.xxhash64("row"), F.col("_pieces")).cast("int"))
    # Both lists are of one piece, about PIECE rows.
    pieces = dealt.groupBy("list", "_piece").agg(*[F.collect_list(c).alias(c) for c in ("row", "id", "label", "q")])
    return keep(pieces.withColumn("group", F.floor(F.col("_piece") / GROUP).cast("int")).drop("_piece"), "pieces"), lists, width


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that the condition anchor names and each of its first positives, the first negatives
    whose score is within window percent of the positive's.
    """
    spark = rows.sparkSession
    used = rows.filter(usable(F.col(label_col), F.col(vec_col)))
    used = used.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"),
        whole(F.col(vec_col), scale).alias("q"), (F.coalesce(anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("asked"),
    )
    used = keep(used, "vectors")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    asked = used.filter("asked")
    if asked.isEmpty():
        return spark.createDataFrame([], out)
    pieces, lists, width = build(used)
    low, high = (F.array(F.lit(x).cast("long")) for x in (-(1 << 62), 1 << 62))
    anchors = keep(asked.select(F.col("row").alias("anchor"), "label", "q", low.alias("low"), high.alias("high"), low.alias("floor")), "anchors")
    alike = keep(search(anchors, pieces, lists, width, True, positives), "positives")
    # One slot per positive, in order of rank; an anchor with fewer has empty ranges at the end.
    per = alike.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct((F.col("rank") - 1).alias("k"), F.col("score")))).alias("_p"))
    slots = F.sequence(F.lit(0), F.lit(positives - 1))
    least, most = (F.lit(x).cast("decimal(20,0)") for x in window)
    of = lambda j: F.element_at("_p", j).cast("decimal(20,0)")
    lows = F.transform(slots, lambda j: F.coalesce(F.ceil(least * of(j) / 100).cast("long"), F.lit(1 << 62)))
    highs = F.transform(slots, lambda j: F.coalesce(F.floor(most * of(j) / 100).cast("long"), F.lit(-(1 << 62))))
    windows = anchors.select("anchor", "label", "q").join(per, "anchor").withColumn("low", lows).withColumn("high", highs)
    windows = keep(windows.select("anchor", "label", "q", "low", "high", F.col("low").alias("floor")), "windows")
    others = keep(search(windows, pieces, lists, width, False, negatives), "negatives")
    told = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    first = alike.select("anchor", (F.col("rank") - 1).cast("int").alias("slot"), told("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    found = others.select("anchor", "slot", F.col("rank").cast("int").alias("rank"), told("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(first, ["anchor", "slot"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
