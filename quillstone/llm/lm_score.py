"""Language-model scoring by deleted interpolation.

P(w | u v) mixes the maximum-likelihood estimates of the trigram, the bigram and the
unigram with a uniform floor. The weights depend on how often the context was seen
(buckets of log2 frequency) and are learned by expectation-maximisation on a held-out part
of the training documents, with counts from the other part; then all training documents
count. A text is scored with its end as a token.

Whole texts are packed into blocks of a few million words (word hashes as block-local
ids). A block sends each distinct n-gram once, with its count, to the bucket of its hash;
a bucket adds the counts of all blocks and sends totals back in the block's own order. So
frequent n-grams cost one entry per block, nothing is skewed, and every task holds one
block or one bucket. What returns to the driver are counts of events by quantised
probabilities (HALF-octave levels), which the weights are learned from.

Words are told apart by 64-bit hashes and n-grams by 56-bit ones at any corpus size (one of
3e9 n-grams, as 30 GB may hold, meets another with a chance of 4e-8).

Null and empty texts are an end alone; texts are read whole, of any length; rows may repeat;
ids may be null (the id's text is then empty for the split); ties play no part. Without
training rows every text gets the uniform floor; an empty table gives none. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import ascii_lower, keep, words
from quillstone.llm.decontaminate import scramble
from quillstone.llm.simhash import lists_of, sliced

FOLDS, TEST_FOLD, MIX_FOLD = 7, 2, 3
BLOCK = 1_000_000
#: n-gram entries that one bucket should hold.
BUCKET = 1_500_000
#: Bits of the hashes of words, bigrams and trigrams.
WIDTHS = (64, 56, 56)
CONTEXTS = 12
LEVELS = 2  # per octave
COUNT, MIX_SET, TEST = 0, 1, 2
START, END = np.uint64(0x5EED0000000000B1), np.uint64(0x5EED0000000000E5)
M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()) if len(a) else b""


def unpack(b: bytes, dtype) -> np.ndarray:
    if not b:
        return np.empty(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def sorted_kinds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    s = np.sort(h)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    return s[first], np.diff(np.r_[first, len(s)])


def ranks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values, as their sorted table, and the place of each element in it."""
    order = np.argsort(h)
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.empty(0, bool)
    place = np.empty(len(h), np.int32)
    place[order] = (np.cumsum(new) - 1).astype(np.int32)
    return s[new], place


def n_grams(tokens: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
    """Hashes of the unigram, bigram and trigram that end at each token; rows end with END and begin after START."""
    first = np.r_[0, np.cumsum(lens)[:-1]].astype(np.int64)
    one = np.r_[START, tokens[:-1]] if len(tokens) else tokens
    one[first] = START
    two = np.r_[START, one[:-1]] if len(tokens) else tokens
    two[first] = START
    bi = scramble(tokens + one * M2)
    return [tokens, bi, scramble(tokens + one * M2 + two * M3 + np.uint64(3))]


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per block: its documents' ids and lengths and their words, of one part (COUNT, MIX_SET or TEST)."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    part = F.when(fold == TEST_FOLD, TEST).when(fold == MIX_FOLD, MIX_SET).otherwise(COUNT)
    hashed = docs.select(F.col(id_col).alias("_id"), part.alias("part"), F.transform(words(ascii_lower(F.col(text_col))), lambda w: F.xxhash64(w)).alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = 0, {}

        def flush(part: int) -> pa.RecordBatch:
            nonlocal made
            ids, lens, tokens, _ = held.pop(part)
            tokens, lens = np.concatenate(tokens), np.concatenate(lens)
            vocab, inverse = ranks(tokens)
            counts = np.bincount(inverse, minlength=len(vocab))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            made += 1
            block = (TaskContext.get().partitionId() << 24) + made
            listed = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([len(tokens)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                    pa.array([pack(lens.astype(np.uint32))], pa.binary()), pa.array([pack(rank[inverse])], pa.binary()), pa.array([pack(vocab[order])], pa.binary()),
                ],
                ["block", "part", "n", "ids", "lens", "words", "vocab"],
            )

        for batch in sliced(batches, 2):
            flat, starts = lists_of(batch.column(2))
            flat = flat.astype(np.uint64)
            parts = np.asarray(batch.column(1))
            row_of = np.repeat(np.arange(len(parts)), np.diff(starts))
            ended = np.insert(flat, starts[1:], END)
            owner = np.insert(row_of, starts[1:], np.arange(len(parts)))
            lens = np.diff(starts) + 1
            for part in np.unique(parts).tolist():
                rows = np.flatnonzero(parts == part)
                mine = held.setdefault(part, [[], [], [], 0])
                mine[0].append(batch.column(0).take(pa.array(rows)))
                mine[1].append(lens[rows])
                mine[2].append(ended[parts[owner] == part])
                mine[3] += len(mine[2][-1])
                if mine[3] >= BLOCK:
                    yield flush(part)
        for part in sorted(held):
            yield flush(part)

    return hashed.mapInArrow(run, f"block long, part int, n long, ids array<{id_type}>, lens binary, words binary, vocab binary")


def hashes_of(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document lengths of a block, and the n-gram hashes that end at each token, by order."""
    lens = unpack(row["lens"], np.uint32).astype(np.int64)
    tokens = unpack(row["vocab"], np.uint64)[unpack(row["words"], np.uint32)]
    found = n_grams(tokens, lens)
    for order, width in enumerate(WIDTHS):
        found[order] = found[order] >> np.uint64(64 - width)
    return lens, found


def totals(blocks: DataFrame, split: int) -> DataFrame:
    """(block, slot, counted, all): totals of the block's n-grams, in the order of slot; block -1 has sums over the corpus."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, found = hashes_of(row)
                for order in range(3):
                    table, counts = sorted_kinds(found[order])
                    found[order] = None
                    counts = counts.astype(np.uint32) if row["part"] != TEST else np.zeros(len(table), np.uint32)
                    cuts = np.searchsorted(table, np.arange(1, 1 << split, dtype=np.uint64) << np.uint64(WIDTHS[order] - split)) if split else np.empty(0, np.int64)
                    cuts = np.r_[0, cuts, len(table)]
                    slots = [b for b in range(1 << split) if cuts[b] < cuts[b + 1]]
                    step = lambda a: np.diff(a, prepend=np.uint64(0))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([(order << split) + b for b in slots], pa.int32()), pa.array([row["block"]] * len(slots), pa.int64()), pa.array([row["part"]] * len(slots), pa.int32()),
                            pa.array([pack(step(table[cuts[b] : cuts[b + 1]])) for b in slots], pa.binary()), pa.array([pack(counts[cuts[b] : cuts[b + 1]]) for b in slots], pa.binary()),
                        ],
                        ["slot", "block", "part", "hashes", "counts"],
                    )

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        parts = [np.cumsum(unpack(r["hashes"], np.uint64), dtype=np.uint64) for r in rows]
        counts = [unpack(r["counts"], np.uint32) for r in rows]
        ends = np.cumsum([0, *map(len, parts)])
        table, place = ranks(np.concatenate(parts))
        del parts
        total, counted = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
        for r, c, a, b in zip(rows, counts, ends[:-1], ends[1:], strict=True):
            if r["part"] != TEST:
                total[place[a:b]] += c
            if r["part"] == COUNT:
                counted[place[a:b]] += c
        slot = rows[0]["slot"]
        sums = [slot >> split == 0, total.sum(), (total > 0).sum()]
        # Counts without the mixing part are asked by that part alone.
        apart = lambda r, a, b: pack(counted[place[a:b]].astype(np.uint64)) if r["part"] == MIX_SET else b""
        out = [(r["block"], slot, apart(r, a, b), pack(total[place[a:b]].astype(np.uint64)), 0, 0) for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True)]
        out += [(-1, slot, b"", b"", int(sums[1]), int(sums[2]))] if sums[0] else []
        names = ["block", "slot", "counted", "total", "tokens", "kinds"]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    sent = blocks.select("block", "part", "lens", "words", "vocab").mapInArrow(send, "slot int, block long, part int, hashes binary, counts binary")
    return sent.groupBy("slot").applyInArrow(add, "block long, slot int, counted binary, total binary, tokens long, kinds long")


def bucket_of(c2: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Context bucket: by log2 frequency of the two-word context, else of the one-word context."""
    log = lambda c: np.minimum(CONTEXTS - 1, np.log2(np.maximum(c, 1)).astype(np.int64))
    return np.where(c2 > 0, CONTEXTS + 1 + log(c2), np.where(c1 > 0, 1 + log(c1), 0))


BUCKETS = 2 * CONTEXTS + 1


def estimates(row: dict, counts: list[np.ndarray], docs: int, tokens: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Lengths of a block's documents and per token: context bucket, trigram, bigram and unigram estimates, own count."""
    lens, found = hashes_of(row)
    seen = []
    for order in range(3):
        seen.append(counts[order][ranks(found[order])[1]].astype(np.float64))
        found[order] = None
    first = np.r_[0, np.cumsum(lens)[:-1]].astype(np.int64)
    h1, h2 = np.r_[0, seen[0][:-1]], np.r_[0, seen[1][:-1]]
    h1[first] = h2[first] = docs
    p = [seen[2] / np.maximum(h2, 1), seen[1] / np.maximum(h1, 1), seen[0] / max(tokens, 1)]
    return lens, bucket_of(h2, h1), [np.minimum(x, 1.0) for x in p], seen[0]


def level(p: np.ndarray) -> np.ndarray:
    """0 for nothing, else 1 + half-octaves below one."""
    return np.where(p > 0, 1 + np.minimum(126, np.round(-LEVELS * np.log2(np.maximum(p, 1e-300)))), 0).astype(np.int64)


def learn(cells: np.ndarray, n: np.ndarray, floor: float, rounds: int = 60) -> np.ndarray:
    """Weights (buckets x 4: trigram, bigram, unigram, floor) by expectation-maximisation over counted cells."""
    w = np.tile([0.3, 0.3, 0.3, 0.1], (BUCKETS, 1))
    w[: CONTEXTS + 1, 0] = 0
    w[0, 1] = 0
    w /= w.sum(1, keepdims=True)
    if not len(cells):
        return w
    bucket = cells >> 21
    back = lambda l: np.where(l > 0, 2.0 ** (-(l - 1) / LEVELS), 0.0)
    p = np.stack([back(cells >> 14 & 127), back(cells >> 7 & 127), back(cells & 127), np.full(len(cells), floor)], axis=1)
    prior = w.copy()
    for _ in range(rounds):
        share = w[bucket] * p
        share *= (n / share.sum(1))[:, None]
        new = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(4)], axis=1) + prior * 2
        w = new / new.sum(1, keepdims=True)
    w = np.maximum(w, np.where(prior > 0, 1e-5, 0))
    return w / w.sum(1, keepdims=True)


def replies(group: pa.Table, column: str, split: int) -> list[np.ndarray]:
    """Totals per order, each in the block's order of hashes."""
    rows = sorted(group.select(["slot", column]).to_pylist(), key=lambda r: r["slot"])
    out = []
    for order in range(3):
        parts = [unpack(r[column], np.uint64) for r in rows if r["slot"] >> split == order]
        out.append(np.concatenate(parts) if parts else np.empty(0, np.uint64))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    blocks = keep(blocks_of(docs, id_col, text_col), "blocks")
    by_part = {r["part"]: (r["d"], r["n"]) for r in blocks.groupBy("part").agg(F.sum(F.size("ids")).alias("d"), F.sum("n").alias("n")).collect()}
    everything = sum(n for _, n in by_part.values())
    split = max(0, (everything // BUCKET).bit_length())
    answers = keep(totals(blocks, split), "totals")
    corpus = answers.filter("block = -1").agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    tokens, kinds = int(corpus["n"] or 0), int(corpus["v"] or 0)
    train_docs = sum(by_part.get(p, (0, 0))[0] for p in (COUNT, MIX_SET))
    count_docs, count_tokens = by_part.get(COUNT, (0, 0))
    floor = 1 / (kinds + 1)

    def events(left: pa.Table, right: pa.Table) -> pa.Table:
        cells, n = [], []
        for row in left.to_pylist():
            _, bucket, p, _ = estimates(row, replies(right, "counted", split), count_docs, count_tokens)
            l3, l2, l1 = map(level, p)
            c, m = sorted_kinds(bucket << 21 | l3 << 14 | l2 << 7 | l1)
            cells.append(c)
            n.append(m)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"cell": pa.array(join(cells), pa.int64()), "n": pa.array(join(n), pa.int64())})

    part_of = lambda df, cond: df.filter(cond).groupBy("block")
    mixed = part_of(blocks.select("block", "part", "lens", "words", "vocab"), F.col("part") == MIX_SET)
    to_mix = answers.select("block", "slot", "counted").join(blocks.filter(F.col("part") == MIX_SET).select("block"), "block", "left_semi")
    seen = mixed.cogroup(to_mix.groupBy("block")).applyInArrow(events, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn(seen["cell"].to_numpy(np.int64), seen["n"].to_numpy(float), floor)
    id_type = docs.schema[id_col].dataType

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i, row in enumerate(left.select(["part", "lens", "words", "vocab"]).to_pylist()):
            lens, bucket, p, c = estimates(row, replies(right, "total", split), train_docs, tokens)
            log = np.log10(sum(weights[:, k][bucket] * p[k] for k in range(3)) + weights[:, 3][bucket] * floor)
            base = np.log10((c + 1) / (tokens + 1 * (kinds + 1)))
            first = np.r_[0, np.cumsum(lens)[:-1]].astype(np.int64)
            add = lambda x: np.add.reduceat(x, first)
            ids = left.column("ids").chunk(0) if left.column("ids").num_chunks == 1 else left.column("ids").combine_chunks()
            ids = ids.slice(i, 1).flatten()
            out.append(
                pa.table(
                    [ids, pa.array([row["part"] == TEST] * len(ids)), pa.array(lens, pa.int64()), pa.array(add((c > 0).astype(np.int64)), pa.int64()), pa.array([tokens] * len(ids), pa.int64()), pa.array(add(base)), pa.array(add(log))],
                    names=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(out) if out else empty()

    schema = f"_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)

    def empty() -> pa.Table:
        kinds_of = [arrow_id, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.schema(list(zip(["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], kinds_of, strict=True))).empty_table()

    scored = blocks.groupBy("block").cogroup(answers.filter("block >= 0").select("block", "slot", "total").groupBy("block")).applyInArrow(judge, schema)
    return scored.withColumnRenamed("_id", id_col)
