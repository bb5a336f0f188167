"""Each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
import corpus_pipeline  # noqa: E402
from quillstone.llm import common, mixing, queries, toxicity  # noqa: E402
from quillstone.llm.common import keep  # noqa: E402
from quillstone.session import TABLES  # noqa: E402
from tools.compare import canon  # noqa: E402

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_llm_operators import ODD, empty, jaccard_roots, wide  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, keep(stage(spark, docs, sf), f"test-{name}")
        out.append((name, before, docs))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_stay(stages):
    assert [n for n, *_ in stages] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    assert all(after.columns == before.columns for _, before, after in stages)


def test_toxicity_stage(spark, sf, stages):
    _, before, after = stages[0]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(before, queries.toxicity_model(spark, sf, before)).collect()}
    assert ids(after) == {i for i, s in scores.items() if s < toxicity.THRESHOLD}


def test_exact_stage(stages):
    _, before, after = stages[1]
    top = defaultdict(int)
    for r in before.collect():
        top[r["text"]] = max(top[r["text"]], r["doc_id"])
    assert ids(after) == set(top.values())


def test_near_stage(stages):
    _, before, after = stages[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect())
    assert ids(after) == jaccard_roots([i for i, _ in rows], [t for _, t in rows])


def test_decontamination_stage(spark, sf, stages):
    _, before, after = stages[3]
    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {r["doc_id"] for r in before.collect() for x in items if " ".join(x) in " ".join(re.findall(r"\w+", r["text"].lower()))}
    assert ids(before) - ids(after) == whole


def test_mixing_stage(stages):
    _, before, after = stages[4]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(before).collect()}
    got = defaultdict(int)
    for r in after.select("doc_id").collect():
        got[r["doc_id"]] += 1
    assert dict(got) == {i: c for i, c in copies.items() if c}


def test_run(spark, sf, stages):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r["doc_id"] for r in stages[-1][2].collect())


def test_a_run_leaves_one_table(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    rows = corpus_pipeline.run(spark, sf)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["stage-mixing"] and rows.count()


#: Ids that stay of the odd rows: nothing is toxic or holds an item; of equal texts the largest id stays, of near ones the least; null ids are no near-copies.
STAY = {
    "exact_dedup": [7, 2, 4, 5, 6], "near_dedup": [None, None, 1, 3, 5, 6], "decontamination": [r[0] for r in ODD],
}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_and_empty_tables(spark, sf, name, stage):
    docs = wide(spark)
    done = stage(spark, docs, sf)
    assert done.columns == docs.columns
    got = Counter(r["doc_id"] for r in done.collect())
    if name in STAY:
        assert got == Counter(STAY[name])
    nothing = stage(spark, empty(spark), sf)
    assert nothing.columns == empty(spark).columns and nothing.count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    got = con.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    rows = lambda rs, at: sorted(tuple(canon(r[at(c)]) for c in sorted(names)) for r in rs)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.collect(), lambda c: c) == rows(got.fetchall(), names.index)
