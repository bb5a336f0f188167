"""Stored indexes against full scans: same rows, fewer files, recall of probes."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.operators import search, text_index, vector_index

VECTORS = "id long, vector array<float>"


def drawn_vectors(n=1500, width=16, centres=20, seed=2):
    rng = np.random.default_rng(seed)
    c = rng.normal(0, 1, (centres, width))
    return [(i, (c[i % centres] + rng.normal(0, 0.25, width)).astype(np.float32).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rows = drawn_vectors()
    path = str(tmp_path_factory.mktemp("vectors"))
    df = spark.createDataFrame(rows, VECTORS)
    vector_index.build(df, path, "id", "vector")
    return rows, df, path, vector_index.VectorIndex(spark, path)


def opened(df):
    """Files that a scan reads rows of; an empty folder has none."""
    return {r[0] for r in df.select("_metadata.file_path").distinct().collect()}


def exact(rows, query, k):
    q = np.asarray(query)
    scored = [(-round(float(np.asarray(v) @ q / (np.linalg.norm(v) * np.linalg.norm(q))), 6), i) for i, v in rows if any(v)]
    return [i for _, i in sorted(scored)[:k]]


def test_recall_of_probes_and_files_read(spark, vectors):
    rows, _, path, index = vectors
    every = opened(spark.read.parquet(f"{path}/lists"))
    found = wanted = 0
    for i, q in [r for r in rows if r[0] % 50 == 0]:
        want = set(exact(rows, q, 10))
        lists = index.nearest(q, 4)
        if i % 250 == 0:
            read = opened(index.rows(lists))
            assert read < every and len(read) <= len(every) / 3
            held = {r["id"] for r in index.rows(lists).select("id").collect()}
            assert {r["id"] for r in index.search(q, 10, probes=4).collect()} <= held
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 50 == 0], "query_id long, vector array<float>")
    for r in index.search_all(asked, 10, probes=4).groupBy("query_id").agg(F.collect_list("id").alias("ids")).collect():
        want = set(exact(rows, dict(rows)[r["query_id"]], 10))
        found, wanted = found + len(want & set(r["ids"])), wanted + len(want)
    assert wanted == 300 and found / wanted >= 0.9


def test_plan_opens_the_probed_folders_alone(vectors):
    _, _, _, index = vectors
    plan = index.search([1.0] * 16, 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1][:80]


def test_exact_searches_equal_the_full_scan(spark, vectors):
    rows, df, _, index = vectors
    rng = np.random.default_rng(9)
    for query in ([1.0] * 16, rows[3][1], rng.normal(0, 1, 16).tolist()):
        want = [tuple(r) for r in search.vector_search(df, query, 25, "id", "vector").collect()]
        assert [tuple(r) for r in index.search(query, 25, probes=1, exact=True).collect()] == want
        assert [tuple(r) for r in index.search(query, 25, probes=10_000).collect()] == want
    # Tight lists: the bound leaves most of them closed.
    kth = index.search(rows[0][1], 10, exact=True).agg(F.min("score")).first()[0]
    assert len(index.within(rows[0][1], kth)) < len(index.names) / 2
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 150 == 0], "query_id long, vector array<float>")
    got = {}
    for r in index.search_all(asked, 10, probes=2, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {i: exact(rows, v, 10) for i, v in rows if i % 150 == 0}


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (None, [0.5, 0.5]), (5, [0.0, 1.0])]
    path = str(tmp_path / "odd")
    vector_index.build(spark.createDataFrame(rows, VECTORS), path, "id", "vector")
    index = vector_index.VectorIndex(spark, path)
    assert [r["id"] for r in index.search([1.0, 0.1], 9, exact=True).collect()] == [1, 1, None, 5]
    assert index.search([], 3).count() == 0 and index.search([1.0], 3).count() == 0 and index.search([0.0, 0.0], 3).count() == 0
    vector_index.build(spark.createDataFrame([], VECTORS), path, "id", "vector")
    index = vector_index.VectorIndex(spark, path)
    assert index.search([1.0, 0.0], 3, exact=True).count() == 0 and index.search_all(spark.createDataFrame(rows, "query_id long, vector array<float>"), 3).count() == 0


TEXTS = ["", None, "ab", "abc", "Banana bandana", "aaaaaaa", "the cat\nthat sat", "ÜBER übergröße \U0001f600\U0001f600\U0001f600 x", "x" * 5000 + "needle" + "y" * 3000]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path_factory.mktemp("texts"))
    text_index.build_grams(df, path, "id", "text")
    text_index.build_terms(df, path, "id", "text")
    return rows, df, path


def places(text, pattern):
    low, p = (text or "").lower(), pattern.lower()
    return [i for i in range(len(low)) if low.startswith(p, i)] if text is not None else []


@pytest.mark.parametrize("pattern", ["ana", "aaa", "aaaa", "a b", "ab ca", "BANDANA", "übergröße", "\U0001f600\U0001f600", "needle", "xxneedleyy", "nothing here", "a", "ab", "th", "abcabcabc", "that"])
def test_places_equal_a_scan(spark, texts, pattern):
    rows, df, path = texts
    got = sorted(tuple(r) for r in text_index.substring_places(spark, path, pattern, df).collect())
    assert got == sorted((i, p) for i, t in rows for p in places(t, pattern))
    hit = {r["id"] for r in text_index.containing(spark, path, pattern, df).collect()}
    assert hit == {i for i, t in rows if places(t, pattern)}


def test_a_pattern_without_a_trigram_needs_the_texts(spark, texts):
    with pytest.raises(ValueError, match="trigram"):
        text_index.containing(spark, texts[2], "ab")


def test_the_rarest_grams_come_first_and_cover_the_pattern():
    keys = text_index.gram_keys(text_index._codes("abcdefgh")).tolist()
    chosen = text_index.cover(keys, dict(zip(keys, [9, 1, 9, 9, 2, 9], strict=True)))
    assert [at for at, _ in chosen][:2] == [1, 4] and {p for at, _ in chosen for p in range(at, at + 3)} == set(range(8))


def test_filters_reach_the_stored_postings(spark, texts):
    _, _, path = texts
    for df, column in ((text_index.terms(spark, path, ["banana", "cat"]), "term"), (text_index.stored_grams(spark, path, "grams", [5, 6]), "gram")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "bucket" in plan.split("PartitionFilters")[1][:120] and f"In({column}" in plan
        assert opened(df.sparkSession.read.parquet(f"{path}/{column}s").filter(F.col("bucket").isin(text_index.buckets_of(spark, [5, 6] if column == "gram" else ["banana", "cat"], "long" if column == "gram" else "string")))) < opened(spark.read.parquet(f"{path}/{column}s"))


def test_stored_ranks_and_stages_equal_the_scan(spark, texts):
    _, df, path = texts
    key = lambda r: tuple(r)
    for asked in (["ab"], ["aab", "cat", "Über"], ["nope"], []):
        want = sorted(map(key, search.cover_rank(df, "id", "text", asked).collect())) if asked else []
        assert sorted(map(key, text_index.rank_terms(spark, path, asked).collect())) == want
    for stages, substring, split in (([["nope"], ["cat", "ab"]], None, []), ([["nope"]], "needle", ["cat"]), ([["nope"]], "zzzzzz", ["cat", "sat"]), ([["nope"]], "zzzzzz", []), ([], None, [])):
        want = [tuple(r) for r in search.by_staged_terms(df, "id", "text", stages, substring, split, 5).collect()]
        assert [tuple(r) for r in text_index.staged(spark, path, stages, substring, split, 5).collect()] == want


def test_a_task_lists_the_documents_of_a_term_or_trigram_once(monkeypatch):
    """Postings of many documents are one row before they are shuffled, and come back as they were."""
    texts_ = [(i, t) for i, t in enumerate(["the cat the", None, "", "ab", "cat", "x" * 300 + "cat"] * 20)]
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in texts_], "text": [t for _, t in texts_]})
    for step, most in ((1, 120), (10**6, 1)):
        monkeypatch.setattr(text_index, "STEP", step)
        stored = list(text_index._gram_batches(iter([batch])))
        cat = int(text_index.gram_keys(text_index._codes("cat"))[0])
        assert sum(r["gram"] == cat for b in stored for r in b.to_pylist()) <= most
        got = {(r["gram"], r["id"]): r["places"] for b in text_index._gram_rows(iter(stored)) for r in b.to_pylist()}
        want = {}
        for i, t in texts_:
            for at, k in enumerate(text_index.gram_keys(text_index._codes(t or "")).tolist()):
                want.setdefault((k, i), []).append(at)
        assert got == want
        words = pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else t.split() for _, t in texts_], pa.list_(pa.string()))], ["id", "terms"])
        rows = [r for b in text_index._term_batches(iter([words])) for r in b.to_pylist()]
        assert sum(r["term"] == "the" for r in rows) <= most
        assert sorted((r["term"], i, n) for r in rows for i, n in zip(r["ids"], r["positions"], strict=True)) == sorted((w, i, t.split().count(w)) for i, t in texts_ if t for w in set(t.split()))


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1])
    data, width = text_index.packed(values)
    assert text_index.unpacked(data).tolist() == values.tolist() and width.tolist() == [1, 1, 1, 2, 2, 3, 4, 5, 5]


def test_rows_of_one_id_are_counted_together(spark, tmp_path):
    text_index.build_terms(spark.createDataFrame([(1, "cat cat"), (1, "cat"), (2, "Cat-dog")], "id long, text string"), str(tmp_path), "id", "text")
    assert sorted(tuple(r) for r in text_index.terms(spark, str(tmp_path), ["CAT", "dog"]).select("id", "term", "positions").collect()) == [(1, "cat", 3), (2, "cat", 1), (2, "dog", 1)]
