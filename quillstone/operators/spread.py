"""Joins in which very many rows share a key."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that are joined in one place.
ROWS = 200_000
#: Places of rows with a null key, which match nothing.
NULLS = 1024
#: Characters of a table that is sent to all tasks.
SENT = 8_000_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """left.join(right, on, how), inner or left, where a few keys may hold most rows of left; right has few rows a key.

    Keys of more than ROWS rows, which are no more than a ROWS-th of the rows, are counted first and broadcast. Their rows are
    dealt to pieces by a hash of the column `by`, and what they meet is repeated per piece. Left is read twice.
    """
    often = left.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > ROWS)
    pieces = F.broadcast(often.select(*on, F.ceil(F.col("_n") / ROWS).alias("_pieces")))
    lost = reduce(or_, [F.col(c).isNull() for c in on])
    many = F.when(lost, F.lit(NULLS)).otherwise(F.coalesce("_pieces", F.lit(1)))
    dealt = left.join(pieces, on, "left").withColumn("_piece", F.pmod(F.xxhash64(by), many)).drop("_pieces")
    held = right.join(pieces, on, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return dealt.join(held, [*on, "_piece"], how).drop("_piece")


def met(left: DataFrame, right: DataFrame, on: list[str], by: str) -> DataFrame:
    """left.join(right, on, "left") that leaves left where it lies if right is small, and else is spread_join; right is read twice."""
    size = right.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return left.join(F.broadcast(right), on, "left") if size <= SENT else spread_join(left, right, on, by, "left")
