"""Queries on small tables of their own beside their SQL: what larger tables brought to light."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.operators import lines, search, snippets, vector_index
from quillstone.plans import catalogue, dataflow
from tools.compare import canon


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    got = con.execute(catalogue.SQL[name])
    names = [d[0] for d in got.description]
    theirs = sorted(tuple(canon(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    ours = sorted(tuple(canon(r[c]) for c in sorted(names)) for r in df.collect())
    assert ours == theirs
    return ours


PART = "p_partkey long, p_brand string, p_type string, p_name string, p_size int, p_retailprice double"


def test_found_symbols_are_cut_by_id(spark, tmp_path):
    """Classes hold the name three times and functions twice; of 40 hits the first 20 ids are asked for."""
    part = spark.createDataFrame([(i, "Brand#12", "T", f"a b{i}", 40 if i <= 25 else 20, 900.1) for i in range(1, 41)], PART)
    assert len(same_as_sql(spark, tmp_path, "r12_r22_find_symbol", part=part)) == 20


PAGES = "page_id long, html string"
CUT = [(1, "<p>the one&amp;&amp;&amp</p><p>that &eacute; &lt;</p>"), (2, "<div>les deux &ampe que&#39;s &amp;lt;</div><br>eine"), (3, None), (4, "no tag &amp"), (5, "<p>the &nbsp;a &#233;</p>")]


def test_passages_decode_the_references_of_their_sql(spark, tmp_path):
    """A reference that is cut before its semicolon, and one that is not listed, stay as written."""
    assert len(same_as_sql(spark, tmp_path, "r31_r32_passages", pages=spark.createDataFrame([r for r in CUT if r[0] != 4], PAGES))) > 3


def test_selected_passages_decode_the_references_of_their_sql(spark, tmp_path):
    assert len(same_as_sql(spark, tmp_path, "r33_r34_select_passages", pages=spark.createDataFrame([r for r in CUT if r[0] != 4], PAGES))) > 2


def test_equal_ranges_are_compared_as_packs(spark, monkeypatch):
    """16 million pairs of rows of 20 x 20 ranges: rows of equal ranges meet as packs, however often a row is repeated."""
    monkeypatch.setattr(lines, "PACK", 64)
    rows = lambda n, kinds, at: spark.range(n).select(F.lit("f").alias("k"), (F.col("id") % 20).cast("int").alias(f"{at}_start"), (F.col("id") % 20 + 5).cast("int").alias(f"{at}_end"), (F.col("id") % kinds).alias(at))
    left, right = rows(4000, 4000, "l"), rows(4000, 20, "r")
    got = lines.overlap_join(left, right, "k", bin_lines=4)
    assert got.columns == ["k", "l_start", "l_end", "l", "r_start", "r_end", "r"]
    want = sum(200 * 200 for a in range(20) for b in range(20) if a <= b + 5 and a + 5 >= b)
    assert got.count() == want and got.groupBy("l", "r").count().agg(F.min("count"), F.max("count")).first()[:] == (200, 200)
    sizes = lines._packed(right, "k", "r_start", "r_end", "_r").select(F.size("_r").alias("n")).agg(F.count("*"), F.max("n"), F.sum("n")).first()
    assert sizes[0] < 200 and sizes[1] <= 4 * 64 and sizes[2] == 4000


def test_points_meet_distinct_ranges(spark):
    """40 000 points beside 40 000 copies of one range of their bin: 1.6e9 comparisons where copies are joined."""
    n = 40_000
    ranges = spark.range(n).select(F.lit("f").alias("file"), F.lit(5).alias("r_start"), F.lit(6).alias("r_end"))
    points = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("point_id"), F.when(F.col("id") % 2 == 0, 6).otherwise(7).alias("at"))
    found = lines.contained(points, ranges, "file")
    assert found.agg(F.count("*"), F.max("at")).first()[:] == (n // 2, 6)
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in joined[joined.index("Join LeftSemi") :]


def test_parsed_files_are_dealt_to_all_cores(spark, sf):
    """The part table is one split, whatever its files take to parse."""
    assert dataflow.code(spark, sf, dataflow.PYTHON, "python", ".py").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_a_task_tells_each_snippet_once():
    """Two texts of 300 000 characters hold the snippets at nearly every place; the later text brings nothing new."""
    every = lambda keys: np.ones(len(keys), bool)
    text = "ab" * 150_000
    batch = pa.RecordBatch.from_pydict({"file_path": ["f"] * 3, "file": [1] * 3, "source_no": [2, 1, 3], "kind": ["k"] * 3, "text": [text, text + "c", text]})
    out = [r for b in snippets._found([1, 2, 3], every, every)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["snippet"], r["source_no"]) for r in out if r["source_no"] == 2) == [("a", 2), ("ab", 2), ("aba", 2), ("b", 2), ("ba", 2), ("bab", 2)]
    assert sorted((r["snippet"], r["source_no"]) for r in out if r["source_no"] != 2) == [(s, 1) for s in ("a", "ab", "aba", "abc", "b", "ba", "bab", "bc", "c")]


def test_blocks_of_vectors_are_scored_as_columns_are(spark):
    """Scores to the last bit as search.cosine gives them; of very many copies each query keeps few."""
    rng = np.random.default_rng(5)
    v, q = rng.normal(0, 1, (300, 8)).astype(np.float32), rng.normal(0, 1, (4, 8)).astype(np.float32)
    v[100:] = v[100]
    one = lambda x, t: pa.array([x.tolist() if hasattr(x, "tolist") else x], t)
    floats = pa.list_(pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([one(list(range(4)), pa.list_(pa.int64())), one(q, floats), one([-2.0] * 4, pa.list_(pa.float64())), one(list(range(300)), pa.list_(pa.int64())), one(v, floats)], ["q_id", "q", "least", "id", "v"])
    out = [r for b in vector_index._scored(8, 5)(iter([batch])) for r in b.to_pylist()]
    assert len(out) <= 4 * 10
    rows = spark.createDataFrame([(i, x.tolist(), j, y.tolist()) for i, x in enumerate(q) for j, y in enumerate(v)], "query_id int, q array<float>, id int, v array<float>")
    every = {(r["query_id"], r["id"]): r["s"] for r in rows.select("query_id", "id", search.cosine(F.col("v"), F.col("q")).alias("s")).collect()}
    assert all(every[r["query_id"], r["id"]] == r["score"] for r in out)
    for i in range(4):
        best = lambda pairs: sorted(pairs)[:5]
        assert best((-round(s, 6), j) for (a, j), s in every.items() if a == i) == best((-round(r["score"], 6), r["id"]) for r in out if r["query_id"] == i)
