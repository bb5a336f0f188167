"""Stored text indexes: postings by term and positional postings by trigram. [R3, R6-R8, P6, T2]

Both are folders of Parquet whose rows are dealt to folders by a hash of the term or trigram and sorted
by it, so a search opens the folders of what it asks for and its filter reaches the row groups. A task lists the documents
of a term or trigram in one row before anything is shuffled.

Substrings: the text's trigrams, of lower-cased code points, are stored with all their places, packed as distances of
seven bits a byte, and with the number of documents of each. A pattern is covered by trigrams, the rarest first; a
document holds the pattern where all of them stand at their distances, which is exact and reads no
text. Only a pattern shorter than a trigram needs the texts, and scans them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import search
from quillstone.storage import read_foldered, write_foldered

BUCKETS = 64
GRAM = 3
#: Grams or lexemes of one Arrow batch that are sorted at a time.
STEP = 4_000_000


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def buckets_of(spark: SparkSession, keys: list, kind: str) -> list[int]:
    """The folders of some keys; a few, of one query."""
    rows = spark.createDataFrame([(k,) for k in keys], f"key {kind}").select(bucket_of(F.col("key")).alias("b")).distinct()
    return sorted(r["b"] for r in rows.collect())


def _write(rows: DataFrame, path: str, key: str, *order: str) -> None:
    """Rows by folder and sorted; a folder with very many rows is cut into several files."""
    placed = rows.withColumn("bucket", bucket_of(F.col(key))).hint("rebalance", "bucket")
    write_foldered(placed.sortWithinPartitions("bucket", key, *order), path, "bucket")


# --- terms -------------------------------------------------------------------


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lexemes) -> (term, ids, positions): of about STEP lexemes at a time, the documents of each term and how often each holds it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(), dtype=np.int64) // STEP
        cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids, lists = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
            coded = lists.flatten().dictionary_encode()
            key, times = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + pc.list_parent_indices(lists).to_numpy(), return_counts=True)
            term, row = np.divmod(key, len(ids))
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
            offsets = pa.array(np.r_[first, len(term)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(term[first])), pa.ListArray.from_arrays(offsets, ids.take(pa.array(row))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))], ["term", "ids", "positions"]
            )


def build_terms(docs: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """Postings (term, ids, positions) of the lexemes, and the length of each document."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    found = named.select("id", search.lexemes(F.col("text")).alias("terms")).mapInArrow(_term_batches, f"term string, ids array<{kind}>, positions array<long>")
    _write(found, f"{path}/terms", "term")
    named.select("id", F.length("text").alias("n_chars")).write.mode("overwrite").parquet(f"{path}/documents")


def terms(spark: SparkSession, path: str, asked: list[str]) -> DataFrame:
    """Stored postings (id, term, positions) of the asked terms alone."""
    low = sorted({t.lower() for t in asked})
    stored = read_foldered(spark, f"{path}/terms")
    held = stored.filter(F.col("bucket").isin(buckets_of(spark, low, "string")) & F.col("term").isin(low)) if low else stored.filter(F.lit(False))
    rows = held.select("term", F.explode(F.arrays_zip("ids", "positions")).alias("_x"))
    return rows.groupBy(F.col("_x.ids").alias("id"), "term").agg(F.sum("_x.positions").alias("positions"))


def rank_terms(spark: SparkSession, path: str, asked: list[str]) -> DataFrame:
    """(id, score) as search.cover_rank, from the stored postings."""
    return search.rank_postings(terms(spark, path, asked), "id", asked)


# --- trigrams ----------------------------------------------------------------


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def gram_keys(codes: np.ndarray) -> np.ndarray:
    """Each trigram as one whole number: three code points of 21 bits."""
    return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:] if len(codes) >= GRAM else np.empty(0, np.int64)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below 2**32 as bytes of seven bits, the lowest first, the top bit set where more follow; and how many each takes."""
    n = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint8)
    for k in range(5):
        has = n > k
        out[at[has] + k] = (values[has] >> 7 * k) & 127 | np.where(n[has] > k + 1, 128, 0)
    return out, n


def unpacked(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, data[:-1] < 128])
    nth = np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * nth, starts)


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (gram, ids, places): of about STEP grams at a time, the documents of each gram and its places in them, packed."""

    def flush(rows: list[int], keys: list[np.ndarray], ids: pa.Array) -> pa.RecordBatch:
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        row = np.repeat(np.array(rows, np.int64), [len(k) for k in keys])[order]
        at = np.concatenate([np.arange(len(k), dtype=np.int64) for k in keys])[order]
        new_gram = np.r_[True, key[1:] != key[:-1]][: len(key)]
        first = np.flatnonzero(new_gram | np.r_[True, row[1:] != row[:-1]][: len(key)])
        # Of each document the number of places, then the first place and the distance of each further one.
        apart = np.diff(at, prepend=0)
        apart[first] = at[first]
        data, width = packed(np.insert(apart, first, np.diff(np.r_[first, len(key)])))
        begins = np.flatnonzero(new_gram[first])
        offset = np.r_[0, np.cumsum(width)][np.r_[first[begins] + begins, len(width)]]
        places = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(data)])
        docs = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(first)].astype(np.int32)), ids.take(pa.array(row[first])))
        return pa.RecordBatch.from_arrays([pa.array(key[first[begins]]), docs, places], ["gram", "ids", "places"])

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        rows, keys, n = [], [], 0
        for i, t in enumerate(texts):
            if (t := t.as_py()) is None:
                continue
            k = gram_keys(_codes(t))
            rows.append(i)
            keys.append(k)
            n += len(k)
            if n >= STEP:
                yield flush(rows, keys, ids)
                rows, keys, n = [], [], 0
        if keys:
            yield flush(rows, keys, ids)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ids, places) -> (gram, id, places), a row per document."""
    for batch in batches:
        for gram, ids, data in zip(batch.column("gram"), batch.column("ids"), batch.column("places"), strict=True):
            values = unpacked(np.frombuffer(data.as_py(), np.uint8))
            heads, at = [], 0
            for _ in range(len(ids)):
                heads.append(at)
                at += 1 + int(values[at])
            heads_ = np.array(heads, np.int64)
            sizes = values[heads_]
            apart = np.delete(values, heads_)
            ends = np.cumsum(sizes)
            total = np.cumsum(apart)
            before = np.repeat(np.r_[0, total[ends[:-1] - 1]], sizes)
            offsets = pa.array(np.r_[0, ends].astype(np.int32))
            places = pa.ListArray.from_arrays(offsets, pa.array((total - before).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), gram.as_py(), np.int64)), ids.values, places], ["gram", "id", "places"])


def build_grams(docs: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """Positional trigrams (gram, ids, places) of lower-cased texts, their document counts, and the length of each document."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    found = named.select("id", F.lower("text").alias("text")).mapInArrow(_gram_batches, f"gram long, ids array<{kind}>, places binary")
    _write(found, f"{path}/grams", "gram")
    stored = read_foldered(docs.sparkSession, f"{path}/grams")
    _write(stored.groupBy("gram").agg(F.sum(F.size("ids")).alias("documents")), f"{path}/counts", "gram")
    named.select("id", F.length("text").alias("n_chars")).write.mode("overwrite").parquet(f"{path}/documents")


def stored_grams(spark: SparkSession, path: str, part: str, keys: list[int]) -> DataFrame:
    return read_foldered(spark, f"{path}/{part}").filter(F.col("bucket").isin(buckets_of(spark, keys, "long")) & F.col("gram").isin(keys))


def gram_places(stored: DataFrame) -> DataFrame:
    """(gram, id, places) of stored trigrams."""
    kind = stored.schema["ids"].dataType.elementType.simpleString()
    return stored.select("gram", "ids", "places").mapInArrow(_gram_rows, f"gram long, id {kind}, places array<int>")


def cover(keys: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """(offset, gram): trigrams that touch every character of a pattern, the rarest first."""
    length = len(keys) + GRAM - 1
    open_, out = set(range(length)), []
    for at in sorted(range(len(keys)), key=lambda i: (counts[keys[i]], i)):
        if open_ & set(range(at, at + GRAM)):
            out.append((at, keys[at]))
            open_ -= set(range(at, at + GRAM))
    return out


def substring_places(spark: SparkSession, path: str, pattern: str, docs: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, at): every place, from 0, where the lower-cased text holds the lower-cased pattern. docs: read for patterns of one or two characters, which have no trigram."""
    low = pattern.lower()
    keys = gram_keys(_codes(low)).tolist()
    if not keys:
        if docs is None:
            raise ValueError("a pattern shorter than a trigram needs the texts")
        if not low:
            return docs.select(F.col(id_col).alias("id"), F.lit(0).alias("at"))
        # Places follow from the lengths of what stands before, overlaps included.
        parts = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("_t"))
        at = F.filter(F.sequence(F.lit(1), F.length("_t") - (len(low) - 1)), lambda i: F.substring(F.col("_t"), i, F.lit(len(low))) == low)
        return parts.filter(F.contains("_t", F.lit(low))).select("id", F.explode(at).alias("at")).withColumn("at", F.col("at") - 1)
    counts = {r["gram"]: r["documents"] for r in stored_grams(spark, path, "counts", sorted(set(keys))).collect()}
    if len(counts) < len(set(keys)):
        return gram_places(stored_grams(spark, path, "grams", sorted(set(keys))).filter(F.lit(False))).select("id", F.lit(0).alias("at"))
    chosen = cover(keys, counts)
    rows = stored_grams(spark, path, "grams", sorted({g for _, g in chosen}))

    def starts(at: int, gram: int) -> DataFrame:
        return gram_places(rows.filter(F.col("gram") == gram)).select("id", F.transform("places", lambda p: p - at).alias("_s"))

    # The rarest first: each further trigram keeps of a document the starts that it has too.
    found = starts(*chosen[0])
    for at, gram in chosen[1:]:
        both = found.join(starts(at, gram).withColumnRenamed("_s", "_more"), "id")
        found = both.select("id", F.array_intersect("_s", "_more").alias("_s")).filter(F.size("_s") > 0)
    return found.select("id", F.explode("_s").alias("at"))


def containing(spark: SparkSession, path: str, pattern: str, docs: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n_chars) of the documents that hold the pattern in any case."""
    hit = substring_places(spark, path, pattern, docs, id_col, text_col).select("id").distinct()
    return spark.read.parquet(f"{path}/documents").join(hit, "id", "left_semi")


# --- staged search -----------------------------------------------------------


def staged(spark: SparkSession, path: str, stages: list[list[str]], substring: str | None, split: list[str], k: int) -> DataFrame:
    """(id, stage, score) as search.by_staged_terms, from the stored indexes: each stage reads its own terms or trigrams."""
    plan: list[DataFrame] = []
    seen: set[frozenset[str]] = set()

    def term_stage(asked: list[str]) -> None:
        if asked and frozenset(asked) not in seen:
            seen.add(frozenset(asked))
            plan.append(rank_terms(spark, path, asked).select("id", F.lit(0).alias("_len"), "score"))

    for asked in stages:
        term_stage(asked)
    if substring and len(substring) >= search.LEAST_SUBSTRING:
        plan.append(containing(spark, path, substring).select("id", F.col("n_chars").alias("_len"), F.lit(0.0).alias("score")))
    term_stage(split)
    if not plan:
        return spark.read.parquet(f"{path}/documents").select("id", F.lit(0).alias("stage"), F.lit(0.0).alias("score")).limit(0)
    # Of each stage no more than k rows can come back.
    cut = [df.orderBy(F.desc("score"), "_len", "id").limit(k).withColumn("stage", F.lit(n)) for n, df in enumerate(plan)]
    rows = reduce(DataFrame.unionByName, cut)
    first = rows.agg(F.min("stage").alias("_first"))
    kept = rows.join(F.broadcast(first), F.col("stage") == F.col("_first"))
    return kept.orderBy(F.desc("score"), "_len", "id").select("id", "stage", "score")
