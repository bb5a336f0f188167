"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in order of size (then by an id hash), each expects
``target / source_size`` copies, and one random offset is added to the running sum: a
document is emitted once per integer boundary that its interval crosses. Order by size
makes the sample stratified, so the words taken stay near the target.

The running sum is never made in one task: counts of (source, size), of hash buckets in
them and ranks in a bucket are summed separately, so a source or a size with a third of
all rows spreads over many tasks. Null text has size 0, a null source is a source of its
own (last in order); texts are counted whole, of any length; repeated rows are separate
documents, and which of rows with one id, size and source is taken more often makes no
difference to the words taken; an empty table gives none. mix returns all columns of docs,
whatever their names but for _quill_*.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import keep, words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 17
#: Random offset in [0, 1), a multiple of 2**-20 so that whole rates stay exact.
OFFSET = random.Random(SEED).randrange(1 << 20) / (1 << 20)


def targets(per_source: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """per_source(_s, source_size) -> with target: shares by weight, capped, the excess reshared (water filling).

    One row per source passes one task here, never documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy("_s")) - 1) % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("_w", w).withColumn("_cap", F.col("source_size") * max_repeats)
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", "_s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    ranked = (
        ranked.withColumn("_k", F.row_number().over(order))
        .withColumn("_room", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_room") / F.col("_left"))
    )
    level = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_k", "_level"))).over(everything)["_level"]
    return ranked.withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("_w"))).select(
        "_s", "source_size", "target"
    )


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_repeats=MAX_REPEATS, offset=OFFSET) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies and taken (size x copies)."""
    source = F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col)))
    slim = docs.select(
        F.col(id_col).alias("_id"), source.alias("_s"), F.size(words(F.col(text_col))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_h"),
    ).withColumn("_b", F.substring("_h", 1, 3))
    slim = keep(slim, "sizes")
    sizes = slim.groupBy("_s", "size").agg(F.count("*").alias("_n"))
    goal = targets(sizes.groupBy("_s").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, max_repeats)
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_at", F.coalesce(F.sum("_n").over(before("_s", "size")), F.lit(0)))
    cells = slim.groupBy("_s", "size", "_b").agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_in", F.coalesce(F.sum("_n").over(before("_s", "size", "_b")), F.lit(0)))
    cells = cells.join(sizes.join(goal, "_s").select("_s", "size", "_at", "source_size", "target"), ["_s", "size"])
    rank = F.row_number().over(Window.partitionBy("_s", "size", "_b").orderBy("_h", "_id"))
    rows = slim.withColumn("_r", rank).join(
        cells.select("_s", "size", "_b", (F.col("_at") + F.col("_in")).alias("_from"), "source_size", "target"), ["_s", "size", "_b"]
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    i = F.col("_from") + F.col("_r")
    copies = F.least(F.floor(i * rate + offset) - F.floor((i - 1) * rate + offset), F.lit(max_repeats).cast("long"))
    return rows.withColumn("copies", copies).select(
        F.col("_id").alias(id_col), F.when(F.col("_s") != "1", F.substring("_s", 2, 1 << 30)).alias(source_col), "size", "source_size", "target",
        "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mixed documents themselves, each repeated as often as the sample takes it, with the columns of docs.

    Rows that share an id share their total of copies evenly, the remainder going to the first ones.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, **options)
    per_id = plan.groupBy(id_col, source_col, "size").agg(F.sum("copies").alias("_quill_c"), F.count("*").alias("_quill_n"))
    per_id = per_id.select(F.col(id_col).alias("_quill_id"), F.col(source_col).alias("_quill_s"), F.col("size").alias("_quill_z"), "_quill_c", "_quill_n")
    rows = docs.withColumn("_quill_size", F.size(words(F.col(text_col))).cast("long")).join(
        per_id.filter("_quill_c > 0"),
        F.col(id_col).eqNullSafe(F.col("_quill_id")) & F.col(source_col).eqNullSafe(F.col("_quill_s")) & (F.col("_quill_size") == F.col("_quill_z")),
    )
    single = rows.filter("_quill_n = 1").withColumn("_quill_m", F.col("_quill_c"))
    shared = rows.filter("_quill_n > 1")
    place = F.row_number().over(Window.partitionBy(id_col, source_col, "_quill_size").orderBy(text_col))
    shared = shared.withColumn("_quill_p", place).withColumn(
        "_quill_m", F.floor(F.col("_quill_c") / F.col("_quill_n")) + F.when(F.col("_quill_p") <= F.col("_quill_c") % F.col("_quill_n"), 1).otherwise(0)
    )
    copies = single.select(*docs.columns, "_quill_m").unionByName(shared.select(*docs.columns, "_quill_m"))
    return copies.withColumn("_quill_m", F.explode(F.array_repeat(F.lit(1), F.col("_quill_m").cast("int")))).select(docs.columns)
