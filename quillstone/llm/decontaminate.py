"""Benchmark decontamination by rare seeds of word pairs and Smith-Waterman alignment.

Texts are compared as lower-cased runs of letters and digits. Benchmark items are cut into
segments of at most SEGMENT words. A document holds an item when some segment, aligned with
the document (match 1, mismatch and gap -1), scores at least THRESHOLD of its length, so
edited and paraphrased copies count; segments of fewer than SHORT words must match in full,
and items of fewer than three words are no evidence and match nothing.

Only alignments that can reach the score are computed, and none of these is left out: of a
segment of n words an alignment with m matches, e edits and the score m - e >= s has at least
m - 1 - e >= s - 1 pairs of neighbouring words in common with the document, each from another
place of the segment, and as e <= n - s, all of them lie within n - s diagonals. So of the
segment's n - 1 pairs any n - 1 - (s - 1) + 1 hold one that is in common: its seeds are so many
of its pairs, those that the whole corpus has least often, by a first pass that counts. Only
where a seed stands in a document are the segment's other pairs looked at, and where enough of
them lie in a band of diagonals the segment is aligned with the words of that band.

The benchmark is the stated query set: it is taken in blocks of bounded size, each sent to
all tasks, so its size is never assumed. Documents are not shuffled, whatever repeats.
Null texts are empty; texts are read whole, of any length; repeated ids give one row per
(id, item) with the best score; null ids group together; equal scores tie in nothing, as all
pairs return; empty tables give no rows. contaminated returns its own columns alone; clean
returns all columns of docs, whatever their names but for _quill_*.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.simhash import lists_of, sliced

#: Words of the least item, and of a run that is looked up.
LEAST, PAIR = 3, 2
SEGMENT = 64
THRESHOLD = 0.5
SHORT = 8
#: Words of the benchmark in one block.
BLOCK_WORDS = 400_000
PAIRS = 512
#: Places of word pairs that are held at once.
HITS = 1_000_000
#: Words of documents that are looked up at once, or one text.
AT_ONCE = 1 << 17
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def token_hashes(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(found, lambda w: F.xxhash64(w))


def scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def grams(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n tokens, in order; rows are not told apart."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    t = tokens.astype(np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h += t[j : j + m] * MIX[j]
    return scramble(h)


def inside(starts: np.ndarray, n: int, count: int) -> np.ndarray:
    """Whether the run of n tokens that begins at each of count places stays in one row."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return row[:count] == row[n - 1 : n - 1 + count]


class Lookup:
    """Places of hashes in a sorted table, behind a bitmap of their leading bits."""

    def __init__(self, table: np.ndarray):
        self.table = np.unique(table)
        self.shift = np.uint64(64 - 20)
        self.map = np.zeros(1 << 20, bool)
        self.map[self.table >> self.shift] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in the table) of the hashes that are in the table."""
        at = np.flatnonzero(self.map[h >> self.shift])
        if not len(at):
            return at, at
        to = np.searchsorted(self.table, h[at])
        ok = (to < len(self.table)) & (self.table[np.minimum(to, len(self.table) - 1)] == h[at])
        return at[ok], to[ok]


def segments(tokens: np.ndarray) -> list[np.ndarray]:
    if len(tokens) < LEAST:
        return []
    if len(tokens) <= SEGMENT:
        return [tokens]
    starts = [*range(0, len(tokens) - SEGMENT, SEGMENT // 2), len(tokens) - SEGMENT]
    return [tokens[s : s + SEGMENT] for s in starts]


def align(seg: np.ndarray, seg_len: np.ndarray, win: np.ndarray, win_len: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of seg with the same row of win."""
    j = np.arange(win.shape[1], dtype=np.int32)
    live = j[None, :] < win_len[:, None]
    h = np.zeros((len(seg), win.shape[1] + 1), np.int32)
    best = np.zeros(len(seg), np.int32)
    for i in range(seg.shape[1]):
        hit = (win == seg[:, i : i + 1]) & live & (i < seg_len)[:, None]
        t = np.maximum(h[:, :-1] + np.where(hit, 1, -1), h[:, 1:] - 1)
        t = np.maximum(t, 0) + j
        t = np.maximum.accumulate(t, axis=1) - j
        h[:, 1:] = t
        np.maximum(best, t.max(axis=1), out=best)
    return best


class Block:
    """Segments of some benchmark items and their pairs of neighbouring words."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.items = [i for i, _ in items]
        self.of, parts = [], []
        for k, (_, tokens) in enumerate(items):
            for s in segments(tokens):
                self.of.append(k)
                parts.append(s)
        self.of = np.array(self.of, np.int64)
        self.parts = parts
        self.lens = np.array([len(p) for p in parts], np.int64)
        self.padded = np.zeros((len(parts), int(self.lens.max(initial=1))), np.uint64)
        for k, p in enumerate(parts):
            self.padded[k, : len(p)] = p
        pairs = [grams(p, PAIR) for p in parts]
        hashes = np.concatenate(pairs) if parts else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.lookup = Lookup(hashes)
        self.first = np.searchsorted(hashes[order], self.lookup.table)
        self.last = np.searchsorted(hashes[order], self.lookup.table, side="right")
        self.pair_seg = np.repeat(np.arange(len(parts)), [len(p) for p in pairs])[order]
        self.pair_at = (np.concatenate([np.arange(len(p)) for p in pairs]) if parts else np.empty(0, np.int64))[order]

    def need(self, threshold: float) -> np.ndarray:
        """Least score of each segment."""
        return np.where(self.lens < SHORT, self.lens, np.ceil(threshold * self.lens - 1e-9).astype(np.int64))

    def choose(self, counts: np.ndarray, threshold: float) -> None:
        """Take each segment's seeds by how often the corpus has each pair of the table."""
        pairs = np.repeat(np.arange(len(self.lookup.table)), self.last - self.first)
        order = np.lexsort((self.pair_at, counts[pairs], self.pair_seg))
        seg = self.pair_seg[order]
        rank = np.arange(len(seg)) - np.searchsorted(seg, seg)
        seeds = np.sort(order[rank < (self.lens - np.maximum(self.need(threshold) - 1, 1))[seg]])
        self.seed_seg, seed_pair = self.pair_seg[seeds], pairs[seeds]
        self.seed_first, self.seed_last = (np.searchsorted(seed_pair, np.arange(len(self.lookup.table)), side=side) for side in ("left", "right"))

    def seeded(self, at: np.ndarray, to: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sorted row * segments + segment of all rows that hold a seed of a segment."""
        each = self.seed_last[to] - self.seed_first[to]
        at, to, each = at[each > 0], to[each > 0], each[each > 0]
        done = np.r_[0, np.cumsum(each)]
        found, a = np.empty(0, np.int64), 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(done, done[a] + HITS, side="right")) - 1)
            n = each[a:b]
            which = np.repeat(self.seed_first[to[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.searchsorted(starts, np.repeat(at[a:b], n), side="right") - 1
            found = np.union1d(found, row * len(self.parts) + self.seed_seg[which])
            a = b
        return found

    def candidates(self, at: np.ndarray, to: np.ndarray, starts: np.ndarray, need: np.ndarray, band: np.ndarray, seeded: np.ndarray) -> np.ndarray:
        """(row, segment, cell) of each band of diagonals with pairs enough, of the rows and segments that share a seed; a cell reaches over two bands, so any range of one band lies in some cell."""
        each = self.last[to] - self.first[to]
        at = np.repeat(at, each)
        which = np.repeat(self.first[to], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        row, seg = np.searchsorted(starts, at, side="right") - 1, self.pair_seg[which]
        least = np.maximum(need - 1, 1)
        key = row * len(self.parts) + seg
        some = seeded[np.minimum(np.searchsorted(seeded, key), len(seeded) - 1)] == key
        at, which, row, seg = at[some], which[some], row[some], seg[some]
        groups, group, size = np.unique(row * len(self.parts) + seg, return_inverse=True, return_counts=True)
        some = size[group] >= least[seg]
        at, which, row, seg, group = at[some], which[some], row[some], seg[some], group[some]
        if not len(at):
            return np.empty((0, 3), np.int64)
        place = self.pair_at[which]
        cell = (at - place - starts[row]) // band[seg]
        cell = np.r_[cell, cell - 1]
        low = cell.min()
        span = cell.max() - low + 1
        # Pairs of one place of the segment count once.
        own = np.unique((np.r_[group, group] * span + cell - low) * SEGMENT + np.r_[place, place])
        cells, size = np.unique(own // SEGMENT, return_counts=True)
        group = groups[cells // span]
        row, seg = group // len(self.parts), group % len(self.parts)
        return np.c_[row, seg, cells % span + low][size >= least[seg]]

    def match(self, tokens: np.ndarray, starts: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, share of the segment) of verified hits, batch by batch."""
        g = grams(tokens, PAIR)
        at, to = self.lookup.find(g)
        ok = inside(starts, PAIR, len(g))[at] if len(at) else np.empty(0, bool)
        at, to = at[ok], to[ok]
        need = self.need(threshold)
        seeded = self.seeded(at, to, starts)
        # Documents without a seed of anything are done.
        held = np.isin(np.searchsorted(starts, at, side="right") - 1, seeded // max(1, len(self.parts)))
        at, to = at[held], to[held]
        band = np.maximum(self.lens - need, 1)
        done = np.r_[0, np.cumsum(self.last[to] - self.first[to])]
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(done, done[a] + HITS, side="right")) - 1)
            # Parts overlap by the longest alignment.
            c = int(np.searchsorted(at, at[b] + 2 * SEGMENT)) if b < len(at) else b
            key = self.candidates(at[a:c], to[a:c], starts, need, band, seeded)
            a = b
            for k in range(0, len(key), PAIRS):
                row, seg, cell = key[k : k + PAIRS].T
                low = starts[row] + cell * band[seg]
                high = np.minimum(low + self.lens[seg] + 2 * band[seg], starts[row + 1])
                low = np.maximum(low, starts[row])
                place = np.minimum(low[:, None] + np.arange((high - low).max()), len(tokens) - 1)
                best = align(self.padded[seg, : self.lens[seg].max()], self.lens[seg], tokens[place].astype(np.uint64), high - low)
                good = best >= need[seg]
                yield row[good], self.of[seg[good]], best[good] / self.lens[seg[good]]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text", threshold=THRESHOLD, block_words=BLOCK_WORDS) -> DataFrame:
    """(id, item id, score from 0 to 1): the pairs of a document and an item that it holds."""
    spark = docs.sparkSession
    tokens = docs.select(F.col(id_col).alias("_id"), token_hashes(F.col(text_col)).alias("t"))
    # Items that repeat count once, so that a block is bounded whatever repeats.
    items = benchmark.select(F.col(item_id_col).alias("item"), token_hashes(F.col(item_text_col)).alias("t")).distinct()
    total = items.agg(F.sum(F.size("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_words))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id_col].dataType.simpleString()
    found = None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b).collect()
        block = Block([(r["item"], np.array(r["t"], np.int64).astype(np.uint64)) for r in rows])
        if not block.parts:
            continue
        block.choose(pair_counts(spark, tokens, block.lookup.table), threshold)
        part = _block_pairs(spark, tokens, block, threshold, id_type, item_type)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"_id {id_type}, item {item_type}, score double")
    return found.groupBy("_id", "item").agg(F.max("score").alias("score")).select(F.col("_id").alias(id_col), F.col("item").alias(item_id_col), "score")


def pair_counts(spark, tokens: DataFrame, table: np.ndarray) -> np.ndarray:
    """How often all documents hold each pair of a block's table, which bounds what comes to the driver."""
    ready = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = Lookup(ready.value), np.zeros(len(table), np.int64)
        for batch in sliced(batches, 0, AT_ONCE):
            flat, starts = lists_of(batch.column(0))
            g = grams(flat, PAIR)
            at, to = lookup.find(g)
            if len(at):
                counts += np.bincount(to[inside(starts, PAIR, len(g))[at]], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["pair", "n"])

    found = tokens.select("t").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(table), np.int64)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _block_pairs(spark, tokens: DataFrame, block: Block, threshold: float, id_type: str, item_type: str) -> DataFrame:
    ready = spark.sparkContext.broadcast(cloudpickle.dumps(block))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pickle.loads(ready.value)
        names = pa.array(block.items)
        for batch in sliced(batches, 1, AT_ONCE):
            flat, starts = lists_of(batch.column(1))
            for row, item, share in block.match(flat, starts, threshold):
                if len(row):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names.take(pa.array(item)), pa.array(share, pa.float64())], ["_id", "item", "score"])

    return tokens.mapInArrow(verify, f"_id {id_type}, item {item_type}, score double")


def clean(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text", threshold=THRESHOLD) -> DataFrame:
    """The documents that hold no item. Documents that share an id stand or fall together; a null id is an id of its own."""
    bad = contaminated(docs, benchmark, id_col, text_col, item_id_col, item_text_col, threshold).select(F.col(id_col).alias("_quill_id")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("_quill_id")), "left_anti")
