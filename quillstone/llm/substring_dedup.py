"""Substring dedup: bytes covered by a string of LENGTH bytes that starts anywhere else.

Multi-document column-wise construction. Every string has one anchor, the least-hashed
run of GRAM bytes (the leftmost on ties) in its first SHORT bytes, so equal strings have
equal anchors at equal offsets; anchors that occur once in the corpus rule their strings
out. The text around each place of a remaining anchor is a member of that anchor's
collection, where all members are aligned. A task reads its collections one after the
other from a sorted table in the shared folder and builds them column by column: each
round inserts one symbol before the suffix of every member. The symbols in suffix order
are the round's column of the Burrows-Wheeler transform; sorting them stably gives the
next order, and the common prefix of two new neighbours is one more than the least prefix
between their old places. After the last round the members stand in suffix order with
their common prefixes, to the right of the anchor and, mirrored, to the left. A string at
offset c repeats when another member shares its range in both orders. Texts are compared
byte by byte there; hashes only bring members together.

Copies of a whole text count once, as one representative with its number of copies.
Strings repeated inside one text are found in the text itself, so periodic texts do not
swell the collections. An anchor with more than HOT places is not gathered: its strings
are counted by their 128-bit BLAKE2 digests (as texts are told apart by digests too) with
partial aggregation. So a task holds a slice of texts or collections of at most HOT members.

Strings of SHORT bytes that another text holds too are reported beside (n_shared): they
show passages that repeat across documents but are too short to be removed.

Texts are UTF-8 bytes of any length; null is empty; matches never cross texts; repeated
rows are copies; ids may be null or repeat; an empty table gives none. Other columns are
not read, whatever their names, and equal strings tie in nothing: all of them count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import keep, partitions
from quillstone.llm.decontaminate import scramble

LENGTH = 400
#: Bytes of a string that is reported when another text holds it, and of the part of any string that its anchor is drawn from.
SHORT = 256
GRAM = 32
#: Places of an anchor above which its strings are counted instead of gathered: so many members take about 40 MB.
HOT = 20_000
#: Bytes of text hashed at a time, and members of collections ordered at a time.
SLICE = 1 << 22
MEMBERS = 30_000
#: Members whose surroundings are laid out at a time.
PART = 2_000
#: Low bits of a sort key that hold a place.
PLACE_BITS = np.uint64(31)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
LETTERS = np.random.default_rng(41).integers(0, 1 << 63, 256, dtype=np.uint64)
INVERSES = {int(base): np.uint64(pow(int(base), -1, 1 << 64)) for base in BASES}


def text_id(text: Column) -> Column:
    """Sixteen bytes that stand for a distinct text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


class Rolling:
    """Hash of any window of a byte array: polynomials mod 2**64 as differences of prefix sums."""

    def __init__(self, data: np.ndarray, base: np.uint64):
        n = len(data)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.back = np.full(n + 1, INVERSES[int(base)], np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTERS[data] * powers[:n], out=self.sums[1:])

    def at(self, start: np.ndarray | slice, size: int) -> np.ndarray:
        if isinstance(start, slice):
            a = slice(start.start, start.stop)
            return scramble((self.sums[start.start + size : start.stop + size] - self.sums[a]) * self.back[a])
        return scramble((self.sums[start + size] - self.sums[start]) * self.back[start])


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of w values, by block-wise prefix and suffix minima."""
    n = len(key) - w + 1
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int = SHORT, gram: int = GRAM, rolling: Rolling | None = None):
    """Of texts laid end to end: per anchor its row, place, first and last string and the hash of its gram. rolling: the hash of data by the first base, if made before."""
    none = np.empty(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none, none, none
    grams = (rolling or Rolling(data, BASES[0])).at(slice(0, len(data) - gram + 1), gram)
    key = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_min(key, length - gram + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)[:n]
    each = np.maximum(np.diff(starts) - length + 1, 0)
    if not each.any():
        return none, none, none, none, none
    row = np.repeat(np.arange(len(each)), each)
    s = np.arange(n) if len(row) == n else np.arange(len(row)) + np.repeat(starts[:-1] - (np.cumsum(each) - each), each)
    place = place[s]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[first[1:], len(s)] - 1
    return row[first], place[first], s[first], s[last], grams[place[first]].view(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row starts of a string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about so many bytes."""
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = bytes_of(batch.column(1))
        for a, b in slices(starts):
            row, _, _, _, fp = anchors(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
            if not len(row):
                continue
            order = np.lexsort((fp, row))
            row, fp = row[order], fp[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (fp[1:] != fp[:-1])])
            places = np.diff(np.r_[first, len(row)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first] + a)), pa.array(fp[first]), pa.array(places, pa.int32())], ["tid", "fp", "places"])


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """texts(tid, text), copies allowed -> (tid, fps): per text the anchors with more than one place, and which are hot."""
    seen = texts.mapInArrow(_anchor_batches, "tid binary, fp long, places int").groupBy("fp", "tid").agg(F.max("places").alias("places"))
    seen = keep(seen, "anchors")
    counted = seen.groupBy("fp").agg(F.sum("places").alias("_n")).filter("_n > 1")
    return seen.join(counted, "fp").groupBy("tid").agg(F.collect_list(F.struct("fp", (F.col("_n") > HOT).alias("hot"))).alias("fps"))


def kinds_of(data: np.ndarray, s: np.ndarray, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings of a text at s, with hashes h: which occur more than once, and which are the first of their kind."""
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    least = s[first[kind]]
    far = np.flatnonzero(s != least)
    if len(far):
        # Neighbours whose firsts are neighbours too share all but one byte, so each run of them is compared once.
        mine, least = s[far], least[far]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(mine) != 1) | (np.diff(least) != 1)]))
        size = np.diff(np.append(cut, len(mine))) + length - 1
        raw = memoryview(data)
        if any(raw[x : x + n] != raw[y : y + n] for x, y, n in zip(mine[cut].tolist(), least[cut].tolist(), size.tolist(), strict=True)):
            # Two strings with one hash: tell the kinds apart by their bytes.
            _, first, kind = np.unique([data[x : x + length].tobytes() for x in s.tolist()], return_index=True, return_inverse=True)
    return np.bincount(kind)[kind] > 1, first[kind] == np.arange(len(s))


def members_of(data: np.ndarray, fps: np.ndarray, hots: np.ndarray) -> tuple[list, list, np.ndarray]:
    """Of one text: (fp, anchor, first, last, bytes) for the collections; (length, digest, place) to count; places of long strings repeated in it."""
    rolling = Rolling(data, BASES[0])
    _, place, low, high, fp = anchors(data, np.array([0, len(data)]), rolling=rolling)
    order = np.argsort(fps)
    at = np.searchsorted(fps[order], fp)
    asked = (at < len(fps)) & (fps[order][np.minimum(at, len(fps) - 1)] == fp)
    place, low, high, fp = place[asked], low[asked], high[asked], fp[asked]
    hot = hots[order][at[asked]]
    if not len(fp):
        return [], [], np.empty(0, np.int64)
    each = high - low + 1
    owner = np.repeat(np.arange(len(fp)), each)
    s = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + low[owner]
    long = s + LENGTH <= len(data)
    hashed = [rolling, Rolling(data, BASES[1])]
    kinds = lambda t, size: kinds_of(data, t, size, hashed[0].at(t, size) ^ (hashed[1].at(t, size) << np.uint64(1)))
    again, first = (np.zeros(len(s), bool), np.ones(len(s), bool))
    again[long], first[long] = kinds(s[long], LENGTH)
    runs = np.flatnonzero(first & ~hot[owner])
    cold = []
    if len(runs):
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(runs) > 1) | (np.diff(owner[runs]) != 0)]))
        a, b = runs[cut], runs[np.append(cut[1:], len(runs)) - 1]
        k, raw = owner[a], data.tobytes()
        cold = [(*r, raw[r[2] : r[3] + LENGTH]) for r in zip(fp[k].tolist(), place[k].tolist(), s[a].tolist(), s[b].tolist(), strict=True)]
    counted = []
    if hot.any():
        raw = data.tobytes()
        heat = hot[owner]
        short = s[heat]
        for size, t in ((LENGTH, s[first & long & heat]), (SHORT, short[kinds(short, SHORT)[1]])):
            counted += [(size, hashlib.blake2b(raw[x : x + size], digest_size=16).digest(), x) for x in t.tolist()]
    return cold, counted, s[again]


MEMBER = "tid binary, fp long, place int, low int, high int, context binary, size int, digest binary"


def _member_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp null marks what is not for a collection: a string to count (size and digest), or long strings repeated in the text (low to high)."""
    schema = pa.schema([("tid", pa.binary()), ("fp", pa.int64()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("context", pa.binary()), ("size", pa.int32()), ("digest", pa.binary())])
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        data, starts = bytes_of(batch.column(1))
        fps, asks = batch.column(2).flatten(), np.cumsum([0, *batch.column(2).value_lengths().fill_null(0).to_pylist()])
        marks, hot = fps.field("fp").to_numpy(), fps.field("hot").to_numpy(zero_copy_only=False)
        rows: list[tuple] = []
        for i, tid in enumerate(batch.column(0).to_pylist()):
            mine = slice(asks[i], asks[i + 1])
            cold, counted, local = members_of(data[starts[i] : starts[i + 1]], marks[mine], hot[mine])
            rows += [(tid, fp, place, low, high, text, None, None) for fp, place, low, high, text in cold]
            rows += [(tid, None, None, s, s, None, size, digest) for size, digest, s in counted]
            rows += [(tid, None, None, a, b, None, None, None) for a, b in spans_of(np.sort(local))]
            if len(rows) > 20_000:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)


def spans_of(s: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of neighbouring sorted places."""
    if not len(s):
        return []
    cut = np.flatnonzero(np.r_[True, np.diff(s) > 1])
    ends = np.r_[cut[1:], len(s)] - 1
    return list(zip(s[cut].tolist(), s[ends].tolist(), strict=True))


def column_wise(columns: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the members by group and suffix, and the common prefix of each with the one before (-1 at the start of a group).

    Round by round one symbol is inserted before every member's suffix, from the last column to the first.
    """
    order = np.argsort(group, kind="stable")
    group = group[order].astype(np.int64)
    start = np.r_[True, group[1:] != group[:-1]] if len(group) else np.empty(0, bool)
    prefix = np.where(start, -1, 0)
    symbols = np.ascontiguousarray(columns.T)
    inner = ~start
    for c in range(columns.shape[1] - 1, -1, -1):
        # The round's column of the transform: the symbol before each suffix, in suffix order.
        bwt = symbols[c][order]
        differ = np.flatnonzero((bwt[1:] != bwt[:-1]) & inner[1:])
        if len(differ):
            moved = np.zeros(int(group[-1]) + 1, bool)
            moved[group[differ]] = True
            at = np.flatnonzero(moved[group])
            key = group[at] << 8 | bwt[at]
            new = np.argsort(key, kind="stable")
            key, old = key[new], prefix[at]
            kin = np.flatnonzero(key[1:] == key[:-1]) + 1
            least = np.where(start[at], -1, -2)
            if len(kin):
                bounds = np.stack([new[kin - 1] + 1, new[kin] + 1], axis=1).reshape(-1)
                # The least prefix between the old places of two neighbours with one symbol.
                least[kin] = np.minimum.reduceat(np.r_[old, 0], bounds)[::2]
            order[at] = order[at][new]
            rest = inner.copy()
            rest[at] = False
            prefix[rest] += 1
            prefix[at] = np.where(least == -2, 0, np.where(least == -1, -1, least + 1))
        else:
            prefix[inner] += 1
    return order, prefix


def repeated_offsets(group: np.ndarray, text: np.ndarray, left: np.ndarray, right: np.ndarray, left_len: np.ndarray, right_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members x offsets: whether the string of LENGTH, and the one of SHORT bytes that another text holds, that starts so many bytes before the anchor repeats."""
    n = len(group)
    long, short = np.zeros((n, left.shape[1] + 1), bool), np.zeros((n, left.shape[1] + 1), bool)
    (ro, rp), (lo, lp) = column_wise(right, group), column_wise(left, group)
    for back in range(left.shape[1] + 1):
        lc = np.empty(n, np.int64)
        lc[lo] = np.cumsum(lp < back)
        for size, out in ((LENGTH, long), (SHORT, short)):
            at = np.flatnonzero((left_len >= back) & (right_len >= size - back))
            if len(at) < 2:
                continue
            rc = np.empty(n, np.int64)
            rc[ro] = np.cumsum(rp < size - back)
            key = rc[at] * (n + 1) + lc[at]
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            own = text[at[order]]
            apart = np.diff(np.r_[first, len(at)]) > 1 if size == LENGTH else np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
            out[at[order], back] = np.repeat(apart, np.diff(np.r_[first, len(at)]))
    return long, short


def _solve(rows: pa.Table) -> pa.RecordBatch | None:
    """Repeated strings among whole collections."""
    fp = rows.column("fp").to_numpy()
    tid = rows.column("tid").combine_chunks().dictionary_encode()
    text = tid.indices.to_numpy().astype(np.int64)
    place, low, high = (rows.column(c).to_numpy().astype(np.int64) for c in ("place", "low", "high"))
    # A row that was read twice (a repeated input row) is one member.
    order = np.lexsort((low, text, fp))
    same = (fp[order][1:] == fp[order][:-1]) & (text[order][1:] == text[order][:-1]) & (low[order][1:] == low[order][:-1])
    at = np.sort(order[np.r_[True, ~same]])
    group = np.unique(fp[at], return_inverse=True)[1]
    at = at[np.bincount(group)[group] > 1]
    if not len(at):
        return None
    data, starts = bytes_of(rows.column("context").take(pa.array(at)).combine_chunks())
    fp, text, place, low, high = fp[at], text[at], place[at], low[at], high[at]
    middle, ends = starts[:-1] + place - low, starts[1:]
    left, right = np.zeros((len(at), SHORT - GRAM), np.uint8), np.zeros((len(at), LENGTH), np.uint8)
    right_len = np.minimum(ends - middle, LENGTH)
    for a in range(0, len(at), PART):
        part = slice(a, a + PART)
        for out, to, held in ((left, -1 - np.arange(left.shape[1]), lambda x: x >= starts[:-1][part, None]), (right, np.arange(LENGTH), lambda x: x < ends[part, None])):
            where = middle[part, None] + to
            out[part] = np.where(held(where), data[np.clip(where, 0, len(data) - 1)], 0)
    hits = repeated_offsets(np.unique(fp, return_inverse=True)[1], text, left, right, place - low, right_len)
    out: list[list[np.ndarray]] = [[], [], [], []]
    back = np.arange(left.shape[1] + 1)
    for size, hit in zip((LENGTH, SHORT), hits, strict=True):
        # A member has no string nearer to the anchor than its last one.
        hit &= (back >= (place - high)[:, None]) & (back <= (place - low)[:, None])
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).view(np.int8), axis=1)
        (r, near), far = np.nonzero(edge == 1), np.nonzero(edge == -1)[1] - 1
        for column, value in zip(out, (text[r], place[r] - far, place[r] - near, np.full(len(r), size)), strict=True):
            column.append(value)
    tids, *rest = (np.concatenate(x) for x in out)
    return pa.RecordBatch.from_arrays([tid.dictionary.take(pa.array(tids)), *(pa.array(x, pa.int32()) for x in rest)], ["tid", "low", "high", "size"])


def _collection_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole collections are solved together."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < MEMBERS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        fp = table.column("fp").to_numpy()
        cut = int(np.searchsorted(fp, fp[-1]))
        if cut:
            if (done := _solve(table.slice(0, cut))) is not None:
                yield done
            held = table.slice(cut).combine_chunks().to_batches()
            count = len(fp) - cut
    if held and (done := _solve(pa.Table.from_batches(held).combine_chunks())) is not None:
        yield done


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a range."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(ends, n), -1)
    return np.cumsum(edge)[:-1] > 0


def shared_bytes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> int:
    """Bytes covered by short strings that other texts hold: those that start in the ranges, and their repeats in the text."""
    if not len(starts):
        return 0
    found = covered(len(text) - SHORT + 1, starts, ends)
    rolling = [Rolling(text, base) for base in BASES]
    h = rolling[0].at(slice(0, len(found)), SHORT) ^ (rolling[1].at(slice(0, len(found)), SHORT) << np.uint64(1))
    mine = np.sort(h[found])
    # Most strings that are not asked for are told by a bit of their hash.
    low = np.uint64((1 << min((16 * len(mine)).bit_length(), 22)) - 1)
    bits = np.zeros(int(low) + 1, bool)
    bits[mine & low] = True
    may = np.flatnonzero(bits[h & low] & ~found)
    found[may] = mine[np.minimum(np.searchsorted(mine, h[may]), len(mine) - 1)] == h[may]
    s = np.flatnonzero(found)
    return int(covered(len(text), s, s + SHORT).sum())


def _kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = bytes_of(batch.column(1))
        runs, places = batch.column(2).flatten(), np.cumsum([0, *batch.column(2).value_lengths().fill_null(0).to_pylist()])
        all_lows, all_highs, all_sizes = (runs.field(k).to_numpy().astype(np.int64) for k in ("low", "high", "size"))
        removed, spans, hashes, shared = [], [], [], []
        for i in range(batch.num_rows):
            text = data[starts[i] : starts[i + 1]]
            lows, highs, sizes = (x[places[i] : places[i + 1]] for x in (all_lows, all_highs, all_sizes))
            long = sizes == LENGTH
            gone = covered(len(text), lows[long], highs[long] + LENGTH)
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
            hashes.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
            shared.append(shared_bytes(text, lows[~long], highs[~long] + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (removed, spans, shared)), pa.array(hashes)], ["tid", "n_removed", "n_spans", "n_shared", "kept_sha256"]
        )


def removed_spans(texts: DataFrame, held: DataFrame) -> DataFrame:
    """held(tid, text, fps) -> (tid, low, high, size): runs of starts of repeated strings."""
    members = keep(held.mapInArrow(_member_batches, MEMBER), "members")
    spark = texts.sparkSession
    gathered = members.filter("fp IS NOT NULL").select("fp", "tid", "place", "low", "high", "context")
    solved = gathered.repartition(partitions(spark), "fp").sortWithinPartitions("fp").mapInArrow(_collection_batches, "tid binary, low int, high int, size int")
    counted = members.filter("digest IS NOT NULL").select("tid", "low", "size", "digest").dropDuplicates(["tid", "low", "size"])
    often = counted.groupBy("size", "digest").agg(F.count("*").alias("_n")).filter("_n > 1")
    hot = counted.join(often, ["size", "digest"]).select("tid", "low", F.col("low").alias("high"), "size")
    local = members.filter("fp IS NULL AND digest IS NULL").select("tid", "low", "high", F.lit(LENGTH).alias("size"))
    return solved.unionByName(hot).unionByName(local)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and n_shared."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("_id"), text_id(F.col(text_col)).alias("tid"), text.alias("_text"))
    slim = keep(named.select("_id", "tid", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")), "texts")
    groups = slim.groupBy("tid").agg(F.count("*").alias("_copies"), F.min("_id").alias("_first"), F.first("n_bytes").alias("_n"))
    asked = repeated_anchors(named.select("tid", "_text"))
    asked = asked.join(groups.select("tid", "_first"), "tid")
    # One row of each text is read for its bytes: joining on the id too keeps a text with many copies from meeting in one task.
    held = named.join(asked.select(F.col("tid").alias("_t"), "_first", "fps"), (F.col("tid") == F.col("_t")) & F.col("_id").eqNullSafe(F.col("_first")))
    held = keep(held.select("tid", "_text", "fps"), "held")
    spans = removed_spans(named, held).groupBy("tid").agg(F.collect_list(F.struct("low", "high", "size")).alias("runs"))
    copied = groups.filter((F.col("_copies") > 1) & (F.col("_n") >= SHORT)).select("tid", F.lit(True).alias("_copied"))
    partly = held.join(spans, "tid").select("tid", "_text", "runs").mapInArrow(_kept_batches, "tid binary, n_removed long, n_spans long, n_shared long, kept_sha256 string")
    partly = partly.dropDuplicates(["tid"])
    rows = slim.join(partly, "tid", "left").join(copied, "tid", "left")
    copied = F.coalesce("_copied", F.lit(False))
    gone = copied & (F.col("n_bytes") >= LENGTH)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return rows.select(
        F.col("_id").alias(id_col), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, empty).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_shared", F.lit(0))).cast("long").alias("n_shared"),
    )
