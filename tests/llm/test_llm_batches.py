"""The batches that the pipeline's Python steps hold: small ones, whatever Spark hands over, with the same results."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.llm import near_dedup, toxicity
from quillstone.llm.common import batches_of, text_slices

ROWS, WORDS = 4000, 500
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_sketches_hold_few_words_at_once():
    rng = np.random.default_rng(4)
    tokens = rng.integers(-(1 << 63), 1 << 63, ROWS * WORDS, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(ROWS)), pa.ListArray.from_arrays(pa.array(np.arange(ROWS + 1, dtype=np.int32) * WORDS), pa.array(tokens))], ["_id", "t"])
    tracemalloc.start()
    got = [b.to_pydict() for b in near_dedup._sketch_batches(iter([batch.slice(0, 300)]))]
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    for _ in near_dedup._sketch_batches(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 30 << 20
    # A text's sketch does not depend on what else is in its batch.
    alone = [next(iter(near_dedup._sketch_batches(iter([batch.slice(i, 1)])))).to_pydict() for i in (0, 261, 262, 299)]
    joined = {k: [v for b in got for v in b[k]] for k in got[0]}
    for i, one in zip((0, 261, 262, 299), alone, strict=True):
        assert {k: v[i] for k, v in joined.items()} == {k: v[0] for k, v in one.items()}


def _texts():
    texts = [f"word{chr(97 + i % 26)} " * 100 + f"bad{'x' * (i % 3)}" for i in range(5000)]
    return ["a" * (3 << 20), None, "", *texts, None, "b " * (1 << 20)]


def test_scores_come_in_small_batches():
    texts = _texts()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    model = toxicity.Model(-1.0, {"bad": 2.0, "badx": 0.5, "wor*": -0.25})
    got = list(toxicity.scored_batches(iter([batch, batch.slice(0, 0)]), model, 1, "score"))
    assert len(got) > 3
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 1 << 20 for b in got)
    assert pa.Table.from_batches(got).select(["doc_id", "text"]).equals(pa.Table.from_batches([batch]))
    assert [s for b in got for s in b.column(2).to_pylist()] == [model.score(t or "", {}) for t in texts]


def test_features_come_in_small_batches():
    texts = _texts()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts, pa.string())], ["_key", "_y", "_text"])
    got = list(toxicity._feature_batches(iter([batch])))
    assert len(got) > 3
    assert [f for b in got for f in b.column(2).to_pylist()] == [sorted(toxicity.features_of(t or "")) for t in texts]
    assert [k for b in got for k in b.column(0).to_pylist()] == list(range(len(texts)))


def test_text_slices_lose_no_row():
    texts = pa.array(["x" * n for n in (0, 5, 5, 11, 0, 0, 10, 1)] + [None])
    parts = [b.column(0).to_pylist() for b in text_slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), 0, most=10)]
    assert parts == [["", "x" * 5, "x" * 5], ["x" * 11], ["", "", "x" * 10], ["x", None]]
    assert [t for p in parts for t in p] == texts.to_pylist()
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 10 for p in parts)


def test_batches_of_holds_inside_only(spark):
    before = spark.conf.get(SETTING)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    try:
        for session, inside in (("10000", 1000), ("0", 1000), ("300", 300)):
            spark.conf.set(SETTING, session)
            with batches_of(spark, 1000):
                assert spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] == inside
            assert spark.conf.get(SETTING) == session
    finally:
        spark.conf.set(SETTING, before)
