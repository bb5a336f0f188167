"""What very large tables brought to light: rows that are held, dealt and shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.operators import lines, review, snippets, spread
from quillstone.plans import catalogue
from tests.test_round3 import same_as_sql


def test_pairs_of_packs_are_dealt_to_many_tasks_and_become_rows_one_left_row_at_a_time(spark):
    """A million pairs of ten packs are few bytes: adaptive execution put them into one task, which held all pairs of two packs."""
    rows = lambda n, at: spark.range(n).select(F.lit("f").alias("k"), F.lit(1).alias(f"{at}_start"), (F.col("id") % 10 + 1).cast("int").alias(f"{at}_end"), F.col("id").alias(at))
    got = lines.overlap_join(rows(1000, "l"), rows(1000, "r"), "k")
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and got.count() == 1_000_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    right, left = plan.index("Generate explode(_r"), plan.index("Generate explode(_l")
    assert right < plan.index("Repartition ") < left


def test_pairs_keep_all_columns_and_nulls(spark):
    left = spark.createDataFrame([("f", 1, 5, None, "a"), ("f", 1, 5, None, "a"), ("f", 4, 9, 7, None), (None, 1, 2, 3, "b")], "k string, l_start int, l_end int, x int, y string")
    right = spark.createDataFrame([("f", 5, 6, None), ("f", 5, 6, 8), ("f", 9, 9, 9), ("g", 1, 9, 9)], "k string, r_start int, r_end int, z int")
    for r in (right, right.drop("z")):
        got = lines.overlap_join(left, r, "k", bin_lines=2)
        want = left.join(r, "k").filter("l_start <= r_end AND l_end >= r_start")
        assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and want.count() == 7


def test_drafts_are_shuffled_once(spark, sf):
    """By run, from the lines of the table: they were written to the shared folder and shuffled for four joins and the merge."""
    plan = catalogue.QUERIES["d8_d9_a28_verify"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("/drafts-") == plan.count("/asked-") == 0


LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def test_of_lines_of_one_number_the_most_severe_counts(spark, tmp_path):
    rows = [(i // 3, 1, 1, 1 + i % 3, 20.0 if i % 2 else 5.0, d, 0.01 if d > 0.05 else 0.07, "NRA"[i % 3], "OF"[i % 2], None) for i in range(40) for d in (0.0, 0.09, 0.06)]
    same_as_sql(spark, tmp_path, "d8_d9_a28_verify", lineitem=spark.createDataFrame(rows, LINE))


def test_quotes_are_proven_once_however_drafts_meet_them(spark, monkeypatch):
    """Quotes as lists, code or both, with blanks and nulls, of a file, another file and none; sent to all tasks or dealt to pieces."""
    shape = "draft_id long, run_id long, seq long, file_path string, line_start int, line_end int, severity string, category string, title string, body string, anchor_symbol string, code_fragment string, evidence array<string>"
    files, code, lists = ["f", "g", None], [None, "", "x  = 1", "no"], [None, [], ["y =  2", None], ["z", "x = 1"]]
    rows = [(i, i % 7, i, files[i % 3], i % 20, i % 20, ("minor", "major")[i % 2], "bug", ("local", "breaks every caller")[i % 5 > 3], "", None, code[i % 4], lists[i // 4 % 4]) for i in range(960)]
    drafts = spark.createDataFrame(rows, shape)
    sources = spark.createDataFrame([("f", 0, "quoted_code", "x = 1\n"), ("f", 1, "retrieved_chunk", "y = 2"), ("g", 0, "retrieved_chunk", "x = 1")], "file_path string, source_no int, kind string, text string")
    hunks, shown = spark.createDataFrame([("f", 0, 9), ("g", 3, 4), ("f", 12, 13)], "file_path string, first int, last int"), spark.createDataFrame([("g",)], "file_path string")
    columns = ["draft_id", "covers_line", "has_evidence", "proven", "displaced", "outcome"]
    sent = sorted(review.verify(drafts, sources, hunks, shown).select(columns).collect())
    monkeypatch.setattr(spread, "SENT", 0)
    assert sent == sorted(review.verify(drafts, sources, hunks, shown).select(columns).collect())
    each = sorted(review.judged(drafts, review.collect_evidence(drafts, sources), hunks, shown).select(columns[:4]).collect())
    assert [r[:4] for r in sent] == [r[:] for r in each] and len({r["outcome"] for r in sent}) == 5


def test_bit_sets_hold_all_keys_and_few_others(spark):
    """Each place of each text is tested; one bit a key let 1.5 % of all others pass, of which strings were made and shuffled."""
    rng = np.random.default_rng(3)
    keys, others = rng.integers(-(2**63), 2**63, 1000), rng.integers(-(2**63), 2**63, 200_000)
    test = snippets.bit_set(spark.createDataFrame([(int(k),) for k in keys], "key long"), "key")
    assert test(keys.view(np.uint64)).all() and test(others.view(np.uint64)).mean() < 0.005


def test_what_is_remembered_is_not_told_again_and_forgetting_costs_repeats_only(monkeypatch):
    """Sources by number, by name and null, in any order; the first of equals is always told."""
    every = lambda keys: np.ones(len(keys), bool)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abc"), 30)) for _ in range(60)]
    for nos in (rng.permutation(60).tolist()[:59] + [None], [f"s{i % 7}" for i in range(60)]):
        kinds = [("x", "y", None)[i % 3] for i in range(60)]
        place = lambda no, kind: ((no is not None, no), (kind is not None, kind))
        want = {}
        for no, kind, t in zip(nos, kinds, texts, strict=True):
            for s in {t[i : i + n] for n in (1, 2, 5) for i in range(len(t) - n + 1)}:
                want[s] = min(want.get(s, place(no, kind)), place(no, kind))
        for bits in (2, 12):
            monkeypatch.setattr(snippets, "REMEMBERED", bits)
            cut = lambda a: {"file_path": ["f"] * 5, "file": [1] * 5, "source_no": nos[a : a + 5], "kind": kinds[a : a + 5], "text": texts[a : a + 5]}  # noqa: B023, E731
            shape = pa.schema([("file_path", pa.string()), ("file", pa.int64()), ("source_no", pa.int64() if isinstance(nos[0], int) else pa.string()), ("kind", pa.string()), ("text", pa.string())])
            rows = [r for b in snippets._found([1, 2, 5], every, every)(pa.RecordBatch.from_pydict(cut(a), shape) for a in range(0, 60, 5)) for r in b.to_pylist()]
            got = {}
            for r in rows:
                got[r["snippet"]] = min(got.get(r["snippet"], place(r["source_no"], r["kind"])), place(r["source_no"], r["kind"]))
            assert got == want and (bits == 2 or not isinstance(nos[0], int) or len(rows) < 3 * len(want))


def test_stretches_begin_after_blanks_as_in_their_sql(spark, tmp_path):
    """A stretch is cut from the first characters of a text, unless blanks leave too few."""
    texts = [" " * 500 + "late  start\t\tof a text " * 9, "a\f c\r\n" * 40, "short", "", "word " * 90, "x" * 399 + "  y" + " z" * 80, "  \n" * 200 + "k"]
    rows = [(i, texts[i % len(texts)], "en", "s", 300) for i in range(90)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(same_as_sql(spark, tmp_path, "j16_d10_snippets", documents=documents)) > 20
