"""Per-key ranking, spreading and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in order, by partial aggregation rather than a sort per key. [A10, W3]"""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*[c for c in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_row"))
    return best.select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """At most n rows of each key. [W4, W6, S7]"""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def keepers(df: DataFrame, keys: list[str], keeper: str, *order: Column) -> DataFrame:
    """Each row with the id of the row that its duplicates give way to. [W1]"""
    return df.withColumn("keeper", F.first(keeper).over(Window.partitionBy(*keys).orderBy(*order)))


def directory_spread(paths: DataFrame, k: int, path_col: str = "path") -> DataFrame:
    """k paths: the first of each directory before the others, in path order. [T16, W4]"""
    folder = F.regexp_replace(path_col, "/?[^/]*$", "")
    rank = F.row_number().over(Window.partitionBy("_dir").orderBy(path_col))
    cut = paths.withColumn("_dir", folder).withColumn("_rn", rank).orderBy(F.col("_rn") > 1, path_col).limit(k)
    return cut.drop("_dir", "_rn").orderBy(path_col)


def page_after(df: DataFrame, key: str, after, size: int = 500) -> DataFrame:
    """[T11, X5]"""
    return df.filter(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def path_order(pattern: str, path: Column) -> list[Column]:
    """Alphabetical for a pattern, else the shortest first. [T6]"""
    return [path] if "*" in pattern else [F.length(path), path]


def name_order(name: str, qualified: Column) -> list[Column]:
    """Exact names first. [T7]"""
    return [F.when(qualified == name, 0).otherwise(1), qualified]


def queue_order(running: Column, place: Column) -> list[Column]:
    """[T17]"""
    return [F.desc(running), place]


def capped_listing(df: DataFrame, order: str, most: int = 300) -> DataFrame:
    """At most `most` rows, each with whether there may be more. [T18]"""
    cut = df.orderBy(order).limit(most)
    # One row: whether the listing is full.
    return cut.join(F.broadcast(cut.agg((F.count("*") >= most).alias("more"))))


def last_messages(messages: DataFrame, n: int = 8) -> DataFrame:
    """The last n messages of each conversation without tool and blank ones. [D19]"""
    said = messages.filter((F.col("role") != "tool") & (F.trim("text") != ""))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return said.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")
