"""The symbol graph: resolution of edges, neighbours and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T


def unique_names(symbols: DataFrame) -> DataFrame:
    """(qualified_name, target): full names that occur in one file, with that file's earliest symbol. [A8]"""
    first = F.min_by("symbol_id", F.struct("start_line", "symbol_id"))
    named = symbols.groupBy("qualified_name").agg(F.count_distinct("file_id").alias("_files"), first.alias("target"))
    return named.filter("_files = 1").select("qualified_name", "target")


def singleton_segments(symbols: DataFrame) -> DataFrame:
    """(target_name, target): last name segments of exactly one symbol that is no module. [A9]"""
    named = symbols.filter("kind <> 'module'").groupBy(T.last_segment(F.col("qualified_name")).alias("target_name"))
    return named.agg(F.count("*").alias("_n"), F.min("symbol_id").alias("target")).filter("_n = 1").select("target_name", "target")


def resolve_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with their targets: by full name, and what is left by its last segment with confidence 0.3. [I12, J12, J13, S20]"""
    full = unique_names(symbols).withColumnRenamed("target", "_full")
    short = singleton_segments(symbols).withColumnRenamed("target", "_short")
    found = (
        edges.withColumn("target_name", T.last_segment(F.col("target_qualified_name")))
        .join(full, F.col("target_qualified_name") == full["qualified_name"], "left").drop("qualified_name")
        .join(short, "target_name", "left")
    )
    open_ = F.col("target_symbol_id").isNull()
    by_full, by_short = open_ & F.col("_full").isNotNull(), open_ & F.col("_full").isNull() & F.col("_short").isNotNull()
    return (
        found.withColumn("confidence", F.when(by_short, F.lit(0.3)).otherwise(F.col("confidence")))
        .withColumn("target_symbol_id", F.when(by_full, F.col("_full")).when(by_short, F.col("_short")).otherwise(F.col("target_symbol_id")))
        .withColumn("is_resolved", F.col("target_symbol_id").isNotNull()).drop("_full", "_short").select(*edges.columns, "target_name")
    )


def resolved_count(edges: DataFrame) -> DataFrame:
    """[A5, A22]"""
    return edges.agg(F.count("*").alias("edges"), F.count_if(F.col("target_symbol_id").isNotNull()).alias("resolved"))


def replace_edges(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stored edges without those of the parsed symbols, and the parsed ones. [I11, S21]"""
    return stored.join(parsed.select("source_symbol_id").distinct(), "source_symbol_id", "left_anti").unionByName(parsed)


def neighbours(edges: DataFrame, seeds: DataFrame, kinds=("calls",), incoming: bool = False) -> DataFrame:
    """Edges that leave (or enter) the seeds to symbols outside of them; parallel edges stay. [J4, J5, R19, R20]

    seeds(symbol_id). No kinds means any.
    """
    near, far = ("target_symbol_id", "source_symbol_id") if incoming else ("source_symbol_id", "target_symbol_id")
    used = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    used = used.filter(F.col(far).isNotNull())
    ids = seeds.select(F.col("symbol_id").alias("_seed")).distinct()
    out = used.join(ids, F.col(near) == F.col("_seed"), "left_semi").join(ids, F.col(far) == F.col("_seed"), "left_anti")
    return out.withColumn("neighbour_id", F.col(far))


def with_symbols(found: DataFrame, symbols: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """Neighbours with their symbols and files, the surest first. [J2, T9]"""
    named = found.join(symbols.withColumnRenamed("symbol_id", "neighbour_id").drop("kind"), "neighbour_id").join(files.select("file_id", "path"), "file_id")
    return named.orderBy(F.desc("confidence"), "neighbour_id", "edge_id").limit(k)


def edge_kinds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Histogram of the kinds of edges that enter the seeds from outside. [A6, R21]"""
    return neighbours(edges, seeds, kinds=(), incoming=True).groupBy("kind").agg(F.count("*").alias("n"))


def reachable(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): our extension; breadth first, bounded."""
    seen = seeds.select(F.col("symbol_id").alias("node"), F.lit(0).alias("hop"))
    front = seen
    links = edges.filter(F.col("target_symbol_id").isNotNull()).select(F.col("source_symbol_id").alias("node"), F.col("target_symbol_id").alias("next")).distinct()
    for hop in range(1, hops + 1):
        front = front.select("node").join(links, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen
