"""Exact dedup by a heavy-hitter split over text digests.

Misra-Gries (Spark's ``freqItems``) names at most ``1/support`` digests that may be
frequent; those whose exact count reaches support x rows are frequent, and that bounded
table of winners is broadcast, so hot groups never meet in one task. All other digests
take an ordinary shuffle.

Null text counts as the empty text; texts may be of any length, as only digests move.
Rows that repeat id and text tie: exactly one of them is kept, of rows that differ in
other columns the one with the greatest hash of the whole row. A null id loses against any
id; an empty table gives an empty result. exact_dedup returns its own columns alone;
keep_one returns all columns of docs, whatever their names but for _quill_*.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import keep

SUPPORT = 0.001


def digest(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def frequent(slim: DataFrame, support: float) -> list[str]:
    """Digests of at least support x rows: Misra-Gries candidates, verified by exact counts; at most 1/support."""
    found = slim.freqItems(["text_sha256"], support).first()
    named = [x for x in (found[0] or []) if x is not None] if found else []
    if not named:
        return []
    counts = slim.agg(F.count("*").alias("n")).first()["n"]
    sure = slim.filter(F.col("text_sha256").isin(named)).groupBy("text_sha256").agg(F.count("*").alias("_n")).filter(F.col("_n") >= support * counts)
    return sorted(r["text_sha256"] for r in sure.collect())


def winners(slim: DataFrame, top: list[str]) -> tuple[DataFrame, DataFrame]:
    """(digest, keep_id, group_size, n_top) of the groups in top and of all others; n_top counts rows tied at the top."""
    hot = F.col("text_sha256").isin(top) if top else F.lit(False)

    def grouped(rows: DataFrame) -> DataFrame:
        per_id = rows.groupBy("text_sha256", "_id").agg(F.count("*").alias("_n"))
        first = F.max(F.struct(F.col("_id").isNotNull().alias("a"), F.col("_id").alias("b"), F.col("_n").alias("c")))
        return per_id.groupBy("text_sha256").agg(first.alias("_t"), F.sum("_n").alias("group_size")).select(
            "text_sha256", F.col("_t.b").alias("keep_id"), "group_size", F.col("_t.c").alias("_n_top")
        )

    return grouped(slim.filter(hot)), grouped(slim.filter(~hot))


def decide(slim: DataFrame, support: float = SUPPORT) -> DataFrame:
    """slim(_id, text_sha256) -> the same rows with keep_id, group_size and _n_top."""
    top = frequent(slim, support)
    hot = F.col("text_sha256").isin(top) if top else F.lit(False)
    hot_groups, rest_groups = winners(slim, top)
    # The winners number at most 1/support rows by the guarantee of Misra-Gries, so the broadcast is bounded.
    hot_rows = slim.filter(hot).join(F.broadcast(hot_groups), "text_sha256")
    rest_rows = slim.filter(~hot).join(rest_groups, "text_sha256")
    columns = [*slim.columns, "keep_id", "group_size", "_n_top"]
    return hot_rows.select(columns).unionByName(rest_rows.select(columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and text_sha256."""
    slim = keep(docs.select(F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("text_sha256")), "digests")
    rows = decide(slim, support)
    at_top = F.col("_id").eqNullSafe(F.col("keep_id"))
    plain = rows.withColumn("kept", at_top & (F.col("_n_top") == 1)).filter(~(at_top & (F.col("_n_top") > 1)))
    tied = (
        rows.filter(at_top & (F.col("_n_top") > 1))
        .groupBy("_id", "text_sha256", "keep_id", "group_size")
        .agg(F.count("*").cast("int").alias("_n"))
        .withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        .withColumn("kept", F.col("_k") == 1)
    )
    columns = [F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256"]
    return plain.select(columns).unionByName(tied.select(columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, one per distinct text, with the columns of docs."""
    slim = keep(docs.select(F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("text_sha256")), "digests")
    hot_groups, rest_groups = winners(slim, frequent(slim, support))
    hot_groups = keep(hot_groups, "winners")
    rest_groups = keep(rest_groups.filter("group_size > 1"), "groups")
    marked = docs.withColumn("_quill_sha", digest(F.col(text_col)))

    def named(groups: DataFrame) -> DataFrame:
        return groups.select(F.col("text_sha256").alias("_quill_sha"), F.col("keep_id").alias("_quill_keep"), F.lit(True).alias("_quill_grouped"))

    stays = F.col("_quill_grouped").isNull() | F.col(id_col).eqNullSafe(F.col("_quill_keep"))
    # Frequent digests go on the map side: at most 1/support rows are broadcast.
    staying = marked.join(F.broadcast(named(hot_groups)), "_quill_sha", "left").filter(stays).drop("_quill_keep", "_quill_grouped")
    staying = staying.join(named(rest_groups), "_quill_sha", "left").filter(stays).drop("_quill_keep", "_quill_grouped")
    tied = hot_groups.unionByName(rest_groups).filter("_n_top > 1").select(F.col("text_sha256").alias("_quill_sha"))
    if not tied.take(1):
        return staying.select(docs.columns)
    whole = F.struct(*docs.columns)
    once = staying.join(tied, "_quill_sha", "left_semi").groupBy("_quill_sha").agg(F.max_by(whole, F.xxhash64(F.to_json(whole))).alias("_quill_row"))
    return staying.join(tied, "_quill_sha", "left_anti").select(docs.columns).unionByName(once.select("_quill_row.*"))
