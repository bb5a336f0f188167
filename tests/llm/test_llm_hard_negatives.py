"""Hard negatives against loops over all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import hard_negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def whole(x):
    return max(-(1 << 26), min(1 << 26, math.floor(256 * x)))


def loops(rows, step, positives=5, negatives=3):
    used = [(i, [whole(x) for x in v], n) for i, v, n in rows if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = 1 << 63
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905,E731
    out = []
    for at, (i, v, n) in enumerate(used):
        if i is None or i % step:
            continue
        scored = [(-dot(v, w), last if k is None else k, m == n) for j, (k, w, m) in enumerate(used) if j != at]
        for s, p, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted(x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out += [(i, None if p == last else p, r, None if k == last else k, -s, -t) for r, (t, k, _) in enumerate(fit, 1)]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def mined(df, step):
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % step == 0).collect()), key=key)


@pytest.mark.parametrize("small", [False, True])
def test_matches_loops_over_all_pairs(spark, monkeypatch, small):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.4, 8)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    # A vector that a third of all rows hold, under two labels: ties of the kth score everywhere.
    rows += [(300 + i, rows[0][1], i % 2) for i in range(150)]
    if small:
        for name, value in (("PIECE", 16), ("GROUP", 2), ("PACK", 3), ("FIRST", 1), ("GATHER", 40), ("SAMPLE", 100)):
            monkeypatch.setattr(hard_negatives, name, value)
    got = mined(spark.createDataFrame(rows, VECTORS).repartition(5), 10)
    want = sorted(loops(rows, 10), key=key)
    assert len(want) > 200 and got == want


def test_bounds_hold_for_every_member_and_skip_lists(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 200, (12, 6)).round()
    points = (centres[np.arange(1200) % 12] + rng.normal(0, 3, (1200, 6))).round()
    rows = spark.createDataFrame([(i, i, i % 2, [int(x) for x in p]) for i, p in enumerate(points)], "row long, id long, label long, q array<int>")
    pieces, lists, width = hard_negatives.build(rows)
    bottom, top = lists.bounds(points[:50])
    n = 0
    for r in pieces.collect():
        scores = points[:50] @ np.array([q for q in r["q"]]).T
        assert (scores <= top[:, [r["list"]]]).all() and (scores >= bottom[:, [r["list"]]]).all()
        n += len(r["row"])
    assert n == 1200
    # With clusters this tight most lists lie below the fifth best score.
    kth = np.sort(points[:50] @ points.T, axis=1)[:, -6]
    assert (top >= kth[:, None]).mean() < 0.5


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (5, [0.9], 1), (10, [], 1), (None, [0.7, 0.2], 1), (None, [0.5, 0.5], 2), (7, [0.6, 0.4], 2), (8, [0.6, 0.4], 2), (8, [0.6, 0.4], 2),
        (20, None, 1), (30, [1.0, None], 1), (40, [float("nan"), 1.0], 1), (50, [float("inf"), 1.0], 1), (60, [1.0, 1.0], None), (70, [3e38, -3e38], 3), (80, [-1e9, 2.0], 3), (90, [0.1], 4),
    ]
    got = mined(spark.createDataFrame(rows, VECTORS), 10)
    assert got == sorted(loops(rows, 10), key=key) and got
    wide = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit("x").alias(c) for c in ("row", "id", "q", "list", "group", "anchor", "slot", "score", "rank", "asked", "low", "high", "floor")])
    assert mined(wide, 10) == got
    assert mined(spark.createDataFrame([], VECTORS), 10) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1)], VECTORS), 10) == []
    assert mined(spark.createDataFrame([(10, [1.0], 1)], VECTORS), 10) == []
