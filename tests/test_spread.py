"""Joins whose left side has most rows under one key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstone.operators import review, spread


@pytest.fixture
def small_pieces(spark, monkeypatch):
    """Joins shuffle into sixteen partitions that stay as they are."""
    monkeypatch.setattr(spread, "ROWS", 50)
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def largest(rows):
    """Share of the rows that the fullest partition has."""
    n = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_a_plain_join(spark, small_pieces, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 10 == 3, None).when(F.col("id") % 10 < 6, "often").otherwise(F.concat(F.lit("k"), F.col("id") % 90)).alias("k"), (F.col("id") % 2).alias("j"))
    right = spark.createDataFrame([("often", 0, 1), ("often", 0, 2), ("k7", 1, 3), (None, 1, 4), ("none", 0, 5)], "k string, j long, v int")
    rows = lambda df: sorted(df.select("id", "k", "j", "v").collect(), key=str)
    got = spread.spread_join(left, right, ["k", "j"], "id", how)
    assert rows(got) == rows(left.join(right, ["k", "j"], how)) and largest(got) < 0.25


def test_drafts_of_one_file_and_one_snippet_meet_in_many_tasks(spark, small_pieces):
    """All drafts quote one line of one file: their evidence and their hunks used to meet in one task."""
    drafts = spark.range(2000).select(
        F.col("id").cast("string").alias("draft_id"), F.lit("f").alias("file_path"), F.lit("x  = 1").alias("code_fragment"), F.lit(None).cast("array<string>").alias("evidence"),
        (F.col("id") % 20).alias("line_start"), (F.col("id") % 20).alias("line_end"), F.lit("local").alias("title"), F.lit("").alias("body"),
    )
    sources = spark.createDataFrame([("f", 0, "quoted_code", "y x = 1 z"), ("f", 1, "quoted_code", "x = 1")], "file_path string, source_no int, kind string, text string")
    evidence = review.collect_evidence(drafts, sources)
    assert evidence.count() == 2000 and largest(evidence) < 0.25
    assert evidence.select("snippet", "source_no", "kind").distinct().collect() == [("x = 1", 0, "quoted_code")]
    hunks = spark.createDataFrame([("f", 0, 4), ("f", 10, 11), ("other", 1, 2)], "file_path string, first int, last int")
    out = review.judged(drafts, evidence, hunks, spark.createDataFrame([("g",)], "file_path string"))
    assert out.agg(F.count("*"), F.count_if("covers_line"), F.count_if("has_evidence"), F.count_if("proven")).first()[:] == (2000, 700, 2000, 2000)
