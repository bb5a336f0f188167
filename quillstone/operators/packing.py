"""Greedy packing of a file's lines into chunks, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

TEXT_SOFT, TEXT_HARD, TEXT_LINES = 400, 800, 3


def text_ranges(lines: Column) -> Column:
    """(first, last) of each chunk of a text's lines: cut at a blank line once large enough, at any line once too large. [I6, W5]"""
    kind = "array<struct<first:int,last:int>>"
    start = F.struct(F.lit(1).alias("first"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast(kind).alias("out"))

    def step(acc: Column, line: Column) -> Column:
        n = acc["n"] + 1
        used = acc["used"] + F.length(line) + 1
        size = F.greatest(F.lit(1), F.bround(used / F.lit(3.0)).cast("int"))
        cut = (size >= TEXT_HARD) | ((size >= TEXT_SOFT) & (n - acc["first"] + 1 >= TEXT_LINES) & is_blank(line))
        chunk = F.array(F.struct(acc["first"].alias("first"), n.alias("last"))).cast(kind)
        return F.struct(
            F.when(cut, n + 1).otherwise(acc["first"]).alias("first"), F.when(cut, F.lit(0)).otherwise(used).cast("long").alias("used"), n.alias("n"),
            F.when(cut, F.concat(acc["out"], chunk)).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.when(acc["n"] >= acc["first"], F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("last"))).cast(kind))).otherwise(acc["out"])
    return F.aggregate(lines, start, step, rest)


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*$")


def text_chunks(files: DataFrame) -> DataFrame:
    """(path, symbol, content, token_count, start_line, end_line): chunks of text files without blank ones. [I6]"""
    split = files.select("path", F.split(F.coalesce("content", F.lit("")), "\n").alias("_l"))
    cut = split.select("path", "_l", F.explode(text_ranges(F.col("_l"))).alias("r"))
    content = F.array_join(F.slice("_l", F.col("r.first"), F.col("r.last") - F.col("r.first") + 1), "\n")
    rows = cut.select("path", T.module_path(F.col("path")).alias("symbol"), content.alias("content"), F.col("r.first").alias("start_line"), F.col("r.last").alias("end_line"))
    return rows.filter(~is_blank(F.col("content"))).select("path", "symbol", "content", T.token_estimate(F.col("content")).alias("token_count"), "start_line", "end_line")
