"""Stored tables: only touched buckets are written, and only finished changes are seen."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstone.sources.stored import ConflictError, StoredTable, cascade


def rows(spark, ids, tag="old"):
    return spark.createDataFrame([(i, f"p{i % 7}", tag) for i in ids], "id long, parent string, tag string")


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.parquet")}


def read(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


@pytest.fixture
def stored(spark, tmp_path):
    return StoredTable(spark, str(tmp_path / "t")).create(rows(spark, range(200)), ["id"], buckets=16)


def test_upsert_leaves_other_files_alone(spark, stored):
    before = files(stored.path)
    fresh = rows(spark, [3, 5, 1000], "new")
    m = stored.manifest()
    touched = stored.buckets_of(fresh, m)
    assert stored.upsert(fresh) == len(touched) <= 3
    assert read(stored) == sorted([(i, f"p{i % 7}", "new" if i in (3, 5) else "old") for i in range(200)] + [(1000, "p6", "new")], key=str)
    after = files(stored.path)
    assert {f: t for f, t in after.items() if f in before} == before
    used = {f"{v}/bucket={b}" for b, v in stored.manifest()["at"].items()}
    assert sum(v != m["at"][b] for b, v in stored.manifest()["at"].items() if b in m["at"]) <= len(touched)
    assert stored.vacuum() == 0 and all(any(u in f for u in used) for f in after if f not in before)


def test_a_change_reads_its_own_buckets_alone(stored, spark):
    m = stored.manifest()
    few = stored.buckets_of(rows(spark, [3]), m)
    assert len({r[0] for r in stored.read(few, m).select("_metadata.file_path").distinct().collect()}) == 1


def test_a_killed_change_shows_the_old_rows(spark, stored):
    old, version = read(stored), stored.manifest()["version"]
    fail = F.udf(lambda i: 1 // 0, "string")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        stored.change(rows(spark, range(50)), lambda held: held.withColumn("tag", fail("id")))
    assert read(stored) == old and stored.manifest()["version"] == version
    # Written in full but lost before the manifest's rename: still the old rows.
    m = stored.manifest()
    rows(spark, [1], "lost").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{stored.path}/data/{m['version'] + 1}-lost")
    assert read(stored) == old
    stored.upsert(rows(spark, [1], "new"))
    assert (1, "p1", "new") in read(stored) and not any(r[2] == "lost" for r in read(stored))


def test_two_changes_at_once_conflict(spark, stored):
    m = stored.manifest()
    stored.upsert(rows(spark, [1], "first"))
    with pytest.raises(ConflictError):
        stored._write(rows(spark, [2], "second"), m, [0])
    assert (1, "p1", "first") in read(stored) and not any(r[2] == "second" for r in read(stored))


def test_insert_missing_delete_replace_and_vacuum(spark, stored):
    assert stored.insert_missing(rows(spark, [5, 300, 300], "new")) == 1
    assert stored.insert_missing(rows(spark, [5])) == 0
    assert (5, "p5", "old") in read(stored) and (300, "p6", "new") in read(stored)
    assert stored.delete(rows(spark, [300, 999]).select("id")).count() == 1
    stored.replace_children(rows(spark, [3], "only"), "parent")
    assert [r for r in read(stored) if r[1] == "p3"] == [(3, "p3", "only")]
    assert read(stored) == sorted([(i, f"p{i % 7}", "old") for i in range(200) if i % 7 != 3] + [(3, "p3", "only")], key=str)
    before = read(stored)
    assert stored.vacuum() > 0 and read(stored) == before


def test_cascade_down_a_chain(spark, tmp_path):
    files_, symbols, edges = (StoredTable(spark, str(tmp_path / n)) for n in ("files", "symbols", "edges"))
    files_.create(spark.createDataFrame([(i, i % 3) for i in range(9)], "file_id int, repo int"), ["file_id"], 4)
    symbols.create(spark.createDataFrame([(i, i % 9) for i in range(40)], "symbol_id int, file_id int"), ["symbol_id"], 4)
    edges.create(spark.createDataFrame([(i, i % 40) for i in range(100)], "edge_id int, symbol_id int"), ["edge_id"], 4)
    gone = cascade(spark.createDataFrame([(1,), (77,)], "repo int"), [(files_, "repo"), (symbols, "file_id"), (edges, "symbol_id")])
    dead = {s for s in range(40) if s % 9 % 3 == 1}
    assert gone == [3, len(dead), sum(e % 40 in dead for e in range(100))]
    assert {r["edge_id"] for r in edges.read().collect()} == {e for e in range(100) if e % 40 not in dead}


def test_empty_tables_and_null_keys(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "e"))
    with pytest.raises(FileNotFoundError):
        t.read()
    t.create(rows(spark, []), ["id"], 4)
    assert t.read().count() == 0 and t.upsert(rows(spark, [])) == 0
    t.upsert(spark.createDataFrame([(None, "a", "x"), (1, None, None)], t.read().schema))
    assert len(read(t)) == 2
    t.delete(rows(spark, [1]).select("id"))
    assert read(t) == [(None, "a", "x")]


SYMBOL = "symbol_id long, file_id string, kind string, qualified_name string, start_line int"
EDGE = "edge_id long, source_symbol_id long, target_symbol_id long, target_qualified_name string, kind string, confidence double"


def resolved(df):
    return sorted(((r["edge_id"], r["target_symbol_id"], r["confidence"]) for r in df.collect()), key=str)


def test_incremental_resolution_equals_the_full_form(spark, tmp_path):
    from quillstone.operators.graph import resolve_edges
    from quillstone.operators.name_index import NameIndex

    rng = random.Random(3)
    name = lambda: f"m{rng.randint(0, 3)}.f{rng.randint(0, 150)}"
    symbols = {i: (i, f"file{rng.randint(0, 5)}", rng.choice(["module", "class", "function"]), name(), rng.randint(1, 90)) for i in range(300)}
    edges = [(i, i % 300, rng.choice([None, None, i % 7]), rng.choice([name(), name(), None]), "calls", 0.9) for i in range(600)]
    frame = lambda rows: spark.createDataFrame(list(rows), SYMBOL)
    all_edges = spark.createDataFrame(edges, EDGE)
    index = NameIndex(spark, str(tmp_path / "names")).create(frame(symbols.values()), all_edges, buckets=64)
    assert resolved(index.edges()) == resolved(resolve_edges(all_edges, frame(symbols.values())))
    # About one symbol in a hundred changes: renamed, gone and new ones turn names unique and ambiguous.
    for turn in range(2):
        picked = rng.sample(sorted(symbols), 4)
        removed = [symbols.pop(i) for i in picked]
        added = [(i, f, k, name(), line) for i, f, k, _, line in removed[:3]] + [(1000 + turn, "new", "function", name(), 1)]
        symbols |= {r[0]: r for r in added}
        fresh = [(2000 + turn, 1, None, added[0][3], "calls", 0.8)]
        edges += fresh
        before = files(str(tmp_path / "names/edges"))
        touched = index.apply(frame(removed), frame(added), spark.createDataFrame(fresh, EDGE))
        assert {r["segment"] for r in touched.collect()} == {r[3].rpartition(".")[2] for r in removed + added}
        assert resolved(index.edges()) == resolved(resolve_edges(spark.createDataFrame(edges, EDGE), frame(symbols.values())))
        after = files(str(tmp_path / "names/edges"))
        assert {f: t for f, t in after.items() if f in before} == before and 0 < len(after) - len(before) <= 9
