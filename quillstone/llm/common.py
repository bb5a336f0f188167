"""Helpers shared by the text-preparation operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators define it: space, tab, LF, VT, FF and CR.
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Maximal runs of non-space characters; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


#: Folders of the runs that are under way, the innermost last.
_runs: list[str] = []
#: Attribute of a kept table that names its folder.
_FOLDER = "_quill_folder"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master may do without: it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def run_folder(spark: SparkSession):
    """Tables kept inside share one folder, which goes at the end: write the result elsewhere before that."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    _runs.append(path)
    try:
        yield path
    finally:
        _runs.remove(path)
        _delete(spark, path)


def keep(df: DataFrame, label: str, apart: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    A lazy result reads such tables, so they stay until the caller's run_folder ends, or discard is called for one.
    apart: outside of the run's folder, to outlast it.
    """
    spark = df.sparkSession
    path = f"{_runs[-1] if _runs and not apart else shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    setattr(kept, _FOLDER, path)
    return kept


def discard(*kept: DataFrame | None) -> None:
    """Delete tables that keep wrote and nothing reads any more."""
    for df in kept:
        if path := getattr(df, _FOLDER, None):
            _delete(df.sparkSession, path)


#: Session setting: rows that Spark hands to Python at once.
_ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """What runs inside hands Python at most so many rows at once, so that both sides hold little; fewer, where the session says so."""
    before = spark.conf.get(_ROWS_AT_ONCE)
    if not 0 < int(before) <= rows:
        spark.conf.set(_ROWS_AT_ONCE, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_AT_ONCE, before)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a text column has at most so many bytes in each, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A sieve has at most so many bits (8 MB), however many keys there are.
SIEVE_BITS = 26


def sieve(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that is true for every key (and few other values), to thin rows on the map side before a join.

    One bit a key in a set of at most 2**SIEVE_BITS bits: with more keys it fills up and thins less, but never loses a key.
    """
    spark = keys.sparkSession
    hashed = keys.select(F.xxhash64(column).alias("h"))
    bits = min(SIEVE_BITS, max(16, (32 * hashed.count()).bit_length()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        words = held.view(np.int64)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(words[some], pa.int64())], ["k", "w"])

    words = np.zeros(1 << (bits - 6), np.int64)
    found = hashed.mapInArrow(gather, "k long, w long").groupBy("k").agg(F.bit_or("w").alias("w")).toPandas()
    words[found["k"].to_numpy(np.int64)] = found["w"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(words.view(np.uint8))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        at = h.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)
        return pd.Series((held.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0)

    return lambda value: maybe(F.xxhash64(value))
