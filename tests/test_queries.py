"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from quillstone.plans import catalogue  # noqa: E402
from quillstone.session import TABLES  # noqa: E402
from tools.compare import canon  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    got = con.execute(catalogue.SQL[name])
    names = [d[0] for d in got.description]
    theirs = got.fetchall()
    assert sorted(names) == sorted(df.columns)
    ours = sorted(tuple(canon(r[c]) for c in sorted(names)) for r in rows)
    assert ours == sorted(tuple(canon(r[names.index(c)]) for c in sorted(names)) for r in theirs)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "score"]
