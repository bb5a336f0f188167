"""Passages of attached documents chosen for a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T

HEADING, PASSAGE_CHARS, PASSAGES = 90, 1200, 4


def passages(docs: DataFrame, id_col: str, text_col: str, html: bool = False, listed: bool = False) -> DataFrame:
    """(id, number, passage, next): numbered from one; listed as in T.decoded. [R31, R32]"""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(id_col, T.split_passages(T.plain_text(raw, listed) if html else raw).alias("_p"))
    after = F.try_element_at("_p", F.col("_at") + 2)
    return split.select(id_col, "_p", F.posexplode("_p").alias("_at", "passage")).select(id_col, (F.col("_at") + 1).alias("number"), "passage", after.alias("next"))


def select_passages(found: DataFrame, id_col: str, query: str, k: int = PASSAGES, chars: int = PASSAGE_CHARS) -> DataFrame:
    """(id, number, text, score): the passages of each document nearest to a question. [R33, R34, A26, T14, R42]

    A stem counts the more the fewer passages of the document hold it. Documents stay together per id; a passage row is small.
    """
    wanted = T.stems(F.lit(query))
    hits = found.withColumn("_total", F.count("*").over(Window.partitionBy(id_col))).select(
        id_col, "number", "passage", "next", "_total", F.explode(F.array_intersect(T.stems(F.col("passage")), wanted)).alias("stem")
    )
    df = F.count("*").over(Window.partitionBy(id_col, "stem"))
    scored = hits.withColumn("_w", F.col("_total") / df).groupBy(id_col, "number").agg(
        F.round(F.sum("_w"), 6).alias("score"), F.first("passage").alias("passage"), F.first("next").alias("next")
    )
    body = F.when((F.length("passage") <= HEADING) & F.col("next").isNotNull(), F.concat("passage", F.lit("\n"), "next")).otherwise(F.col("passage"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "number"))
    return scored.withColumn("_rn", rank).filter(F.col("_rn") <= k).select(id_col, "number", T.clip(body, chars).alias("text"), "score")
