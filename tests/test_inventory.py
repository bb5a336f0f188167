from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstone.operators import inventory, navigation, scripts, search
from quillstone.plans import catalogue
from quillstone.sources.files import append


def test_every_row_has_a_function_and_a_query_with_sql():
    """test_queries.py holds each query against its SQL."""
    for row in inventory.ROWS:
        found = inventory.resolve(row)
        assert callable(found) or isinstance(found, dict)
        assert inventory.queries_of(row, catalogue.SQL) or row in inventory.WRITERS, row


def test_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, part string")
    for _ in range(2):
        append(rows, str(tmp_path / "t"), "part")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4 and (tmp_path / "t" / "part=a").is_dir()


def test_stored_postings_are_read_by_term(spark):
    docs = spark.createDataFrame([(1, "the licensed pkg.core_util the"), (2, "nothing"), (3, "pkg.core_util.x, core-util the_end")], "id int, text string")
    search.store_postings(docs, "id", "text", "quill_postings", buckets=4)
    stored = spark.table("quill_postings")
    try:
        for terms in (["the"], ["Licensed", "core"], ["pkg.core_util"], ["util", "x", "none"]):
            want = {tuple(r) for r in search.cover_rank(docs, "id", "text", terms).collect()}
            asked = search.rank_postings(stored, "id", terms)
            assert {tuple(r) for r in asked.collect()} == want
            lexed = docs.select("id", F.round(F.size(F.filter(search.lexemes(F.col("text")), lambda t: t.isin(*[x.lower() for x in terms]))) * F.lit(0.1), 6).alias("s")).filter("s > 0")  # noqa: B023
            assert {tuple(r) for r in lexed.collect()} == want
        plan = search.rank_postings(stored, "id", ["the"])._jdf.queryExecution().toString()
        assert "PushedFilters: [In(term" in plan or "EqualTo(term,the)" in plan
    finally:
        spark.sql("DROP TABLE quill_postings")


def test_no_row_is_both_done_and_outside():
    assert not set(inventory.ROWS) & set(inventory.OUTSIDE)


@pytest.fixture(scope="module")
def code(spark):
    files = spark.createDataFrame([("f1", "app/report.py", "python", False), ("f2", "docs/guide.md", "markdown", False), ("f3", "app/old.py", "python", True)], "file_id string, path string, language string, is_deleted boolean")
    symbols = spark.createDataFrame(
        [(1, "f1", "class", "app.report.Builder", "class Builder:", "Builds.", 1, 9), (2, "f1", "method", "app.report.Builder.total", "def total(self):", None, 2, 4), (3, "f1", "function", "app.report.main", "def main():", "", 10, 12)],
        "symbol_id int, file_id string, kind string, qualified_name string, signature string, docstring string, start_line int, end_line int",
    )
    edges = spark.createDataFrame([("e", 3, 2, "calls", 1.0), ("g", 3, 1, "references", 1.0)], "edge_id string, source_symbol_id int, target_symbol_id int, kind string, confidence double")
    chunks = spark.createDataFrame([(10, "f1", 1, "class Builder:\n  def total(self):\n    return 1", 1, 3), (11, "f1", 3, "def main():\n  Builder().total()", 10, 11), (12, "f2", None, "how to build_total reports", 1, 1)], "chunk_id int, file_id string, symbol_id int, content string, start_line int, end_line int")
    return files, symbols, edges, chunks


def test_navigation(spark, code):
    files, symbols, edges, chunks = code
    assert [r["path"] for r in navigation.search_code(chunks, files, "main").collect()] == ["app/report.py"]
    assert [r["path"] for r in navigation.search_documents(chunks, files, "build_total").collect()] == ["docs/guide.md"]
    assert navigation.search_code(chunks, files, "kubernetes").count() == 0
    assert [r["text"] for r in navigation.definition(symbols, chunks, files, "main").collect()] == ["def main():\n  Builder().total()"]
    assert [r["title"] for r in navigation.related(symbols, edges, files, "total").collect()] == ["app.report.main"]
    assert [r["title"] for r in navigation.related(symbols, edges, files, "main", incoming=False).collect()] == ["app.report.Builder.total"]
    assert [(r["kind"], r["n"]) for r in navigation.hidden_kinds(symbols, edges, "Builder").collect()] == [("references", 1)]
    assert [r["symbol_id"] for r in navigation.outline(symbols, files, "app/report.py").collect()] == [1, 2, 3]
    assert navigation.read_file(chunks, files, "app/report.py").first()["end_line"] == 11
    assert {r["symbol_id"] for r in navigation.find_symbol(symbols, "total").collect()} == {2}
    assert [navigation.resolve_path(files, p).first()["path"] for p in ("/report.py", "x/report.py", "none.py")] == ["app/report.py", "app/report.py", None]
    assert [r["title"] for r in navigation.references(symbols, edges, files, "Builder").collect()] == ["app.report.main"]
    assert navigation.references(symbols, edges, files, "Builder", "calls").count() == 0
    assert [r["symbol_id"] for r in navigation.file_context(symbols, files, "app/report.py", 3, 3).collect()] == [1, 2]
    assert [r["path"] for r in navigation.suggest_paths(files, "src/guide.rst").collect()] == ["docs/guide.md"]
    assert {(r["section"], r["files"]) for r in navigation.describe(files, symbols).collect()} == {("total", 2), ("total", 3), ("language", 1), ("directory", 1)}


def test_diff_context(spark, code):
    _, symbols, edges, _ = code
    sized = symbols.join(spark.createDataFrame([("f1", "app/report.py")], "file_id string, path string"), "file_id").withColumn("tokens", F.lit(800))
    changed = spark.createDataFrame([("k", 3)], "key string, symbol_id int")
    similar = spark.createDataFrame([("k", 1, 0.9)], "key string, symbol_id int, score double")
    r = navigation.diff_context(changed, sized, edges, similar).first()
    assert (r["used"], r["taken"], r["dropped"]) == (1600, ["3", "2"], 1)


def test_grep_windows(spark):
    files = spark.createDataFrame([("a.py", "x\ndef run():\n  pass\nrun()\ny")], "path string, content string")
    assert [(r["first_line"], r["last_line"]) for r in navigation.grep_windows(files, "run", "definition").collect()] == [(1, 5)]
    assert [(r["first_line"], r["last_line"]) for r in navigation.grep_windows(files, "run", "references").collect()] == [(3, 5)]


def test_scripts(spark):
    text = "import { Foo } from './foo';\nexport default class App extends Base {\n}\nconst go = async (x) => {\n};\nexport function run() {}\ninterface Shape {}"
    files = spark.createDataFrame([("src/ui/index.ts", "typescript", text), ("a.py", "python", "class X: pass")], "path string, language string, content string")
    got = {(r["qualified_name"], r["kind"]) for r in scripts.symbols(files).collect()}
    assert got == {("ui", "module"), ("ui.App", "class"), ("ui.go", "function"), ("ui.run", "function"), ("ui.Shape", "class")}
    assert [r["target"] for r in scripts.imports(files).collect()] == ["./foo"]
