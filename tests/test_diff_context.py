"""The context of changed files: which neighbours are taken, and how often pieces are shuffled."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillstone.operators import navigation


def _context(spark, changed, symbols, edges, similar, each=2):
    frames = (
        spark.createDataFrame(changed, "key string, symbol_id int"), spark.createDataFrame(symbols, "symbol_id int, tokens int, path string, start_line int"),
        spark.createDataFrame(edges, "source_symbol_id int, target_symbol_id int, confidence double").withColumn("kind", F.lit("calls")), spark.createDataFrame(similar, "key string, symbol_id int, score double"),
    )
    return navigation.diff_context(*frames, limit=1000, each=each)


def test_context_takes_the_first_neighbours(spark):
    """Files with few and with many symbols, edges that repeat, symbols that are not known."""
    rng = random.Random(5)
    changed = sorted({(f"k{i}", rng.randrange(12)) for i in range(8) for _ in range(1 + i)})
    symbols = [(i, 1, f"p{i % 3}", i) for i in range(20) if i % 7]
    edges = [(rng.randrange(20), rng.randrange(20), rng.choice([0.1, 0.5, 0.5, 0.9])) for _ in range(300)] + [(1, 2, 0.95)] * 9
    similar = [(f"k{rng.randrange(8)}", s, rng.random()) for s in range(20)]
    want = {}
    for key in {k for k, _ in changed}:
        own = {s for k, s in changed if k == key}
        lists = [[(0.0, s) for s in own]]
        for a, b in ((0, 1), (1, 0)):
            lists.append(sorted((-e[2], e[b]) for e in edges if e[a] in own and e[b] not in own)[:2])
        lists.append(sorted((-x, s) for k, s, x in similar if k == key and s not in own)[:1])
        first = {}
        for origin, found in enumerate(lists):
            for _, s in found:
                first.setdefault(s, origin)
        known = {s[0]: s for s in symbols}
        taken = sorted((origin, known[s][2], known[s][3], str(s)) for s, origin in first.items() if s in known)
        if taken:
            want[key] = [t[3] for t in taken]
    assert {r["key"]: r["taken"] for r in _context(spark, changed, symbols, edges, similar).collect() if r["taken"]} == want


def test_context_shuffles_pieces_once(spark):
    """Pieces are shuffled by their file alone; a symbol's calls are cut before they meet the files."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = _context(spark, [("k", 1)], [(1, 1, "p", 1)], [(1, 2, 0.5)], [("k", 3, 0.5)])
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in shuffles if "piece_id" in line], shuffles
    assert [line for line in plan.splitlines() if "WindowGroupLimit [_side" in line], plan
