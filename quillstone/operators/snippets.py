"""Which of very many snippets stand in which of very many texts of the same file. [J16, D10]

A text looks up its own substrings: where the first P characters of some snippet stand, P being the largest power of two that the
snippet reaches, the substrings of all lengths asked for in that class are hashed (a difference of running sums) and kept if
they may be a snippet. Both tests are bit sets of bounded size, and only let pass too much. Of each
substring a task passes on only what stands in an earlier source than it has passed on before, so neither places nor
pairs of texts and snippets are listed; the substrings themselves meet the snippets by an equal join, which is exact. What was
passed on is known by its key of 64 bits and compared with one other key, so a substring is missed with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.storage import kept

#: Window lengths, and the gram of each: short windows are their own gram.
SIZES = (1, 2, 3, 4, 6, 8, 16, 32)
GRAM = {size: size if size <= 8 else size // 2 for size in SIZES}
BASE = np.uint64(0x9E3779B97F4A7C15)
SIZE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bits of the set of anchors: 8 MB at the most, however many there are; a full set only thins less.
MOST_BITS = 26
#: Bits of the places in which a task remembers the substrings it has passed on (10 MB); a later one takes the place of an earlier.
REMEMBERED = 19
#: Characters of texts that are searched at once: few enough for their arrays to stay in a core's own memory.
TOGETHER = 1 << 16


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def scrambled(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(33)
    y ^= x
    y *= np.uint64(0xFF51AFD7ED558CCD)
    z = y >> np.uint64(29)
    z ^= y
    return z


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)], dtype=np.uint64)[:n]


def running_sums(text: np.ndarray) -> np.ndarray:
    return np.r_[np.uint64(0), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, len(text)), dtype=np.uint64)]


def hashes_at(sums: np.ndarray, scale: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of that many characters at each place; scale: powers of BASE."""
    return scrambled((sums[at + size] - sums[at]) * scale[at])


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Rolling hash of every run of that many characters, from one running sum."""
    return hashes_at(running_sums(text), powers(BASE, len(text)), np.arange(len(text) - gram + 1), gram) if len(text) >= gram else np.empty(0, np.uint64)


def anchors(text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the least-hashed gram (the first of equals) of every window of a length."""
    h = gram_hashes(text, GRAM[size])
    wide = size - GRAM[size] + 1
    if len(h) < wide:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if wide == 1:
        return np.arange(len(h)), h
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, wide).argmin(axis=1) + np.arange(len(h) - wide + 1))
    return at, h[at]


def of_size(size: int | np.ndarray) -> np.ndarray:
    return np.asarray(size).astype(np.uint64)[None] * SIZE


def keys_of(file: np.ndarray, size: int | np.ndarray, sums: np.ndarray, scale: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Key of the run of that many characters of a file at each place."""
    return scrambled((sums[at + size] - sums[at]) * scale[at] + file.astype(np.int64).view(np.uint64) + of_size(size).ravel())


def prefix_size(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets -> the keys of their first characters and of the whole."""
    for batch in batches:
        texts = batch.column("snippet").to_pylist()
        files = batch.column("file").to_numpy()
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.array([prefix_size(n) for n in sizes.tolist()], np.int64)
        text = codes("".join(texts))
        sums, scale, at = running_sums(text), powers(BASE, len(text)), np.cumsum(sizes) - sizes
        yield pa.RecordBatch.from_arrays(
            [batch.column("file_path"), batch.column("snippet"), *(pa.array(keys_of(files, size, sums, scale, at).view(np.int64)) for size in (first, sizes)), pa.array(sizes.astype(np.int32))],
            ["file_path", "snippet", "prefix", "key", "length"],
        )


#: Bits of a key in its word, three at most, by its last twelve bits.
MASKS = np.bitwise_or.reduce([np.uint64(1) << (scrambled(np.arange(4096, dtype=np.uint64) + np.uint64(4096 * i)) & np.uint64(63)) for i in (1, 2, 3)])


def places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of each key in a set of so many bits, and its bits there."""
    return (key >> np.uint64(70 - bits)).view(np.int64), MASKS[(key & np.uint64(4095)).view(np.int64)]


def bit_set(keys: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """A test on arrays of keys that holds for every key of the column and for few others."""
    spark = keys.sparkSession
    bits = min(MOST_BITS, max(16, (32 * keys.count()).bit_length()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            np.bitwise_or.at(held, *places(batch.column(0).to_numpy().view(np.uint64), bits))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some].view(np.int64))], ["at", "bits"])

    found = keys.select(column).mapInArrow(gather, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    held = np.zeros(1 << (bits - 6), np.uint64)
    held[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(held)

    def test(key: np.ndarray) -> np.ndarray:
        at, mask = places(key, bits)
        return shared.value[at] & mask == mask

    return test


class Told:
    """Substrings that a task has passed on, each with its source, by the last bits of their keys; forgetting costs repeats only."""

    def __init__(self):
        n = 1 << REMEMBERED
        self.key, self.no, self.kind = np.zeros(n, np.uint64), np.full(n, (1 << 63) - 1), np.full(n, -1, np.int32)

    def fresh(self, key: np.ndarray, row: Callable[[np.ndarray], np.ndarray], no: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which substrings may stand in an earlier source than they are remembered with. Kinds are compared for being equal only.

        row: of some substrings; no, kind: of each row.
        """
        at = (key & np.uint64(len(self.key) - 1)).view(np.int64)
        out = self.key[at] != key
        # Nearly all are remembered with a source before all of these.
        known = np.flatnonzero(~out)
        known = known[self.no[at[known]] >= no.min()]
        at, of = at[known], row(known)
        held = self.no[at]
        out[known] = (self.kind[at] < 0) | (held > no[of]) | ((held == no[of]) & (self.kind[at] != kind[of]))
        return np.flatnonzero(out)

    def add(self, key: np.ndarray, no: np.ndarray, kind: np.ndarray) -> None:
        # Of equal places the last one counts in each of the arrays, so that they agree.
        at, last = np.unique((key & np.uint64(len(self.key) - 1))[::-1], return_index=True)
        last = len(key) - 1 - last
        self.key[at], self.no[at], self.kind[at] = key[last], no[last], kind[last]


def _found(lengths: list[int], begins: Callable[[np.ndarray], np.ndarray], wanted: Callable[[np.ndarray], np.ndarray]):
    """Texts -> (file_path, snippet, source_no, kind): their substrings that may be snippets, of each the sources that come before all earlier rows of the task."""
    classes: dict[int, list[int]] = {}
    for n in lengths:
        classes.setdefault(prefix_size(n), []).append(n)

    def substrings(files: np.ndarray, texts: list[str], nos: np.ndarray, kinds: np.ndarray, rank: np.ndarray, told: Told) -> tuple[list[int], list[str]]:
        """Rows and substrings to pass on; all texts are one array, in which no run crosses an end."""
        text = codes("".join(texts))
        lens = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lens)
        row = np.repeat(np.arange(len(texts)), lens)
        left = ends[row] - np.arange(len(text))
        sums, scale = running_sums(text), powers(BASE, len(text))
        of_file = files.view(np.uint64)[row]
        rows, out = [], []
        for size, asked in classes.items():
            most = max(0, len(text) - size + 1)
            # The key of keys_of at every place.
            key = sums[size : size + most] - sums[:most]
            key *= scale[:most]
            key += of_file[:most]
            key += of_size(size)
            key = scrambled(key)
            at = np.flatnonzero(begins(key) & (left[:most] >= size))
            start, by, file, rest, begun = sums[at], scale[at], of_file[at], left[at], key[at]
            for n in asked:
                fit, key = at, begun
                if n > size:
                    some = np.flatnonzero(rest >= n)
                    fit = at[some]
                    key = sums[fit + n] - start[some]
                    key *= by[some]
                    key += file[some]
                    key += of_size(n)
                    key = scrambled(key)
                new = np.flatnonzero(wanted(key))
                new = new[told.fresh(key[new], lambda some, fit=fit, new=new: row[fit[new[some]]], nos, kinds)]
                # Of equal substrings of these texts the one of the first source.
                if not len(new):
                    continue
                new = new[np.lexsort((rank[row[fit[new]]], key[new]))]
                new = new[np.flatnonzero(np.diff(key[new], prepend=~key[new[:1]]))]
                fit, of = fit[new], row[fit[new]]
                told.add(key[new], nos[of], kinds[of])
                begin = (fit - (ends - lens)[of]).tolist()
                rows += (of := of.tolist())
                out += [texts[i][a : a + n] for i, a in zip(of, begin, strict=True)]
        return rows, out

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Texts of about TOGETHER characters."""
        group = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy()) // TOGETHER
        cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Told()
        numbers: dict[object, int] = {}
        for batch in (piece for whole in batches for piece in pieces(whole)):
            nos, kinds, texts = (batch.column(c).to_pylist() for c in ("source_no", "kind", "text"))
            # Nulls stand before all values, as in Spark's order.
            places = [((no is not None, no), (kind is not None, kind)) for no, kind in zip(nos, kinds, strict=True)]
            rank = np.empty(len(places), np.int64)
            rank[sorted(range(len(places)), key=places.__getitem__)] = np.arange(len(places))
            if pa.types.is_integer(batch.column("source_no").type):
                number = np.array([-(1 << 63) if no is None else no for no in nos], np.int64)
                kind = np.array([numbers.setdefault(k, len(numbers)) for k in kinds], np.int32)
            else:  # other sources are known to be equal or not
                number, kind = np.zeros(len(nos), np.int64), np.array([numbers.setdefault(p, len(numbers)) for p in places], np.int32)
            at, fresh = substrings(batch.column("file").to_numpy(), texts, number, kind, rank, told)
            row = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file_path").take(row), pa.array(fresh, pa.string()), batch.column("source_no").take(row), batch.column("kind").take(row)], ["file_path", "snippet", "source_no", "kind"])

    return run


def first_sources(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """asked(file_path, snippet), sources(file_path, source_no, kind, text) -> (file_path, snippet, source_no, kind).

    Each distinct snippet that some source of its file contains, with the first such source. Empty snippets, null texts and
    null paths match nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in sources.schema}
    file = F.xxhash64("file_path").alias("file")
    distinct = asked.filter("snippet <> '' AND file_path IS NOT NULL").select("file_path", "snippet").distinct().select("file_path", "snippet", file)
    snippets = kept(distinct.mapInArrow(_hashed, f"file_path {kinds['file_path']}, snippet string, prefix long, key long, length int"), "snippets")
    lengths = sorted(r["length"] for r in snippets.select("length").distinct().collect())
    held = sources.filter("text IS NOT NULL AND file_path IS NOT NULL").select("file_path", file, "source_no", "kind", "text")
    run = _found(lengths, bit_set(snippets, "prefix"), bit_set(snippets, "key"))
    found = held.mapInArrow(run, f"file_path {kinds['file_path']}, snippet string, source_no {kinds['source_no']}, kind {kinds['kind']}")
    first = found.groupBy("file_path", "snippet").agg(F.min(F.struct("source_no", "kind")).alias("_s"))
    return snippets.select("file_path", "snippet").join(first, ["file_path", "snippet"]).select("file_path", "snippet", F.col("_s.source_no").alias("source_no"), F.col("_s.kind").alias("kind"))
