"""The interval sweep and the snippet join against plain loops."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import review, snippets, sweep


def innermost(ranges, points):
    out = []
    for key, point, at in points:
        held = [(-s, e, i) for k, i, s, e in ranges if k == key and key is not None and at is not None and s <= at <= e]
        if held:
            out.append((key, point, min(held)[2]))
    return sorted(out)


@pytest.mark.parametrize(("seed", "span", "bin_"), [(1, 60, 4096), (2, 60, 8), (3, 9000, 4096), (4, 5, 2)])
def test_innermost_equals_a_loop(spark, monkeypatch, seed, span, bin_):
    """Nested, crossing, equal and empty ranges; ranges that cross bins."""
    monkeypatch.setattr(sweep, "BIN", bin_)
    rng = random.Random(seed)
    ranges = []
    for i in range(200):
        s = rng.randint(-5, span)
        ranges.append((rng.choice(["a", "b", None]), i, s, s + rng.choice([-1, 0, 1, 3, span // 3, span])))
    points = [(rng.choice(["a", "b", "c", None]), i, rng.choice([None, rng.randint(-9, 2 * span)]) if i % 9 == 0 else rng.randint(-9, 2 * span)) for i in range(300)]
    got = sweep.innermost(spark.createDataFrame(ranges, "file string, range_id long, r_start int, r_end int"), spark.createDataFrame(points, "file string, point_id long, at int"), "file")
    assert got.columns == ["file", "point_id", "range_id"]
    assert sorted(tuple(r) for r in got.collect()) == innermost(ranges, points)


def test_innermost_of_nothing(spark):
    r, p = spark.createDataFrame([], "file string, range_id long, r_start int, r_end int"), spark.createDataFrame([("a", 1, 3)], "file string, point_id long, at int")
    assert sweep.innermost(r, p, "file").count() == 0


def test_a_hot_file_makes_one_row_a_point(spark):
    """Ranges that all hold all points: pairs would be 400 million."""
    n = 20_000
    ranges = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("range_id"), F.col("id").alias("r_start"), (F.lit(4 * n) - F.col("id")).alias("r_end"))
    points = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("point_id"), (F.col("id") + n).alias("at"))
    began = time.perf_counter()
    assert sweep.innermost(ranges, points, "file").agg(F.count("*"), F.min("range_id"), F.max("range_id")).first()[:] == (n, n - 1, n - 1)
    assert time.perf_counter() - began < 60


def first_sources(asked, sources):
    out = set()
    for path, s in asked:
        held = [(n, k) for p, n, k, t in sources if p == path and path is not None and t is not None and s and s in t]
        if held:
            out.add((path, s, *min(held)))
    return sorted(out)


ASKED, SOURCES = "file_path string, snippet string", "file_path string, source_no int, kind string, text string"


def test_snippets_equal_a_loop(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("ab cé\U0001f600") for _ in range(n))
    sources = [(rng.choice(["x", "y", None]), rng.randint(0, 9), rng.choice(["p", "q"]), rng.choice([None, "", text(rng.randint(1, 300)), text(300)])) for _ in range(60)]
    asked = [("x", ""), (None, "a"), ("z", "a"), ("x", text(5000))]
    for _ in range(300):
        path, _, _, t = rng.choice(sources)
        at, n = rng.randint(0, 250), rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 120])
        asked.append((rng.choice([path, "x"]), (t or text(400))[at : at + n] if rng.random() < 0.8 else text(n)))
    got = snippets.first_sources(spark.createDataFrame(asked, ASKED), spark.createDataFrame(sources, SOURCES).repartition(5))
    want = first_sources(asked, sources)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 60


def test_anchors_stand_wherever_the_snippet_stands():
    rng = np.random.default_rng(3)
    for size in snippets.SIZES:
        text = rng.integers(97, 100, 400).astype(np.uint32)
        every = dict(zip(*(x.tolist() for x in snippets.anchors(text, size)), strict=True))
        for i in range(0, 400 - size):
            at, h = snippets.anchors(text[i : i + size], size)
            assert every[i + int(at[0])] == int(h[0])
    assert len(snippets.anchors(rng.integers(97, 120, 100_000).astype(np.uint32), 32)[0]) < 15_000


def test_very_many_snippets_of_one_file_do_not_square(spark):
    """40 000 snippets and 40 000 sources of one file: 1.6e9 pairs of a theta join."""
    n = 40_000
    sources = spark.range(n).select(F.lit("f").alias("file_path"), F.col("id").cast("int").alias("source_no"), F.lit("k").alias("kind"), F.concat(F.lit("def common_name(self, value): return "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    asked = sources.select("file_path", F.substring("text", 20, 40).alias("snippet"))
    began = time.perf_counter()
    found = snippets.first_sources(asked, sources)
    assert found.agg(F.count("*"), F.sum("source_no")).first()[:] == (n, n * (n - 1) // 2)
    assert time.perf_counter() - began < 120


def test_nothing_asked(spark):
    assert snippets.first_sources(spark.createDataFrame([], ASKED), spark.createDataFrame([("f", 1, "k", "abc")], SOURCES)).count() == 0
    assert snippets.first_sources(spark.createDataFrame([("f", "abc")], ASKED), spark.createDataFrame([], SOURCES)).count() == 0


def test_evidence_of_drafts_is_the_first_source(spark):
    drafts = spark.createDataFrame([(1, "f", ["foo  bar", "zzz"], "baz"), (2, "f", None, ""), (3, "g", ["foo bar"], "")], "draft_id int, file_path string, evidence array<string>, code_fragment string")
    sources = spark.createDataFrame([("f", 1, "patch", "a foo\n bar b"), ("f", 0, "shown", "x baz"), ("f", 2, "shown", "foo bar")], SOURCES)
    assert sorted(tuple(r) for r in review.collect_evidence(drafts, sources).collect()) == [(1, "baz", 0, "shown"), (1, "foo bar", 1, "patch")]
