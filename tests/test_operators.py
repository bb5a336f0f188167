from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.operators import digests, documents, filters, graph, index, lines, packing, parsing, review, scripts, search
from quillstone.sources import files as sources
from quillstone.sources import patches
from quillstone.streaming import steps


def test_hybrid_puts_shared_hits_first(spark):
    a = spark.createDataFrame([("x", 9.0), ("s", 8.0)], "id string, score double")
    b = spark.createDataFrame([("s", 0.9), ("y", 0.1)], "id string, score double")
    fused = [r["id"] for r in search.reciprocal_rank_fusion([a, b], [1.0, 1.0], "id", 5).collect()]
    assert fused[0] == "s" and set(fused) == {"s", "x", "y"}
    empty = b.limit(0)
    assert [r["id"] for r in search.reciprocal_rank_fusion([a, empty], [1.0, 0.6], "id", 5).collect()] == ["x", "s"]
    many = spark.createDataFrame([(str(i), float(-i)) for i in range(20)], "id string, score double")
    assert search.reciprocal_rank_fusion([many, empty], [1.0, 1.0], "id", 5).count() == 5


def test_vector_search_edge_cases(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0])], "id int, v array<float>")
    assert [(r["id"], r["score"]) for r in search.vector_search(v, [1.0, 0.0], 9, "id", "v").collect()] == [(1, 1.0), (5, 0.707107)]
    assert search.vector_search(v, [], 9, "id", "v").count() == 0


def test_query_stages():
    exact, substring, split = search.query_stages("branch_select in UnitOfWork")
    assert exact[0] == ["branch_select"] and substring == "branch_select" and "unit" in split and "select" in split


def test_staged_search_prefers_the_exact_word(spark):
    d = spark.createDataFrame([(1, "def branch_select(): pass"), (2, "/catalog_branch_select"), (3, "select one")], "id int, text string")
    rows = lambda *a: [(r["id"], r["stage"]) for r in search.by_staged_terms(d, "id", "text", *a, 9).collect()]
    assert rows([["branch_select"]], None, ["select"]) == [(1, 0)]
    assert rows([["none_such"]], "branch_sel", ["select"]) == [(2, 1), (1, 1)]
    assert {r[0] for r in rows([["none_such"]], None, ["select"])} == {1, 2, 3}


def test_resolution(spark):
    symbols = spark.createDataFrame(
        [(1, "f1", "module", "src.widget", 1), (2, "f2", "module", "src.foo.test", 1), (3, "f3", "module", "src.foo.test", 1), (4, "f1", "function", "src.widget.draw", 5), (5, "f2", "function", "a.paint", 2)],
        "symbol_id int, file_id string, kind string, qualified_name string, start_line int",
    )
    edges = spark.createDataFrame(
        [("a", 9, None, "src.widget", "imports", False, 1.0), ("b", 9, None, "src.foo.test", "imports", False, 1.0), ("c", 9, None, "other.draw", "calls", False, 1.0), ("d", 9, 5, "x", "calls", True, 0.5)],
        "edge_id string, source_symbol_id int, target_symbol_id int, target_qualified_name string, kind string, is_resolved boolean, confidence double",
    )
    once = graph.resolve_edges(edges, symbols)
    got = {r["edge_id"]: (r["target_symbol_id"], r["confidence"], r["is_resolved"]) for r in once.collect()}
    assert got == {"a": (1, 1.0, True), "b": (None, 1.0, False), "c": (4, 0.3, True), "d": (5, 0.5, True)}
    twice = graph.resolve_edges(once.drop("target_name"), symbols)
    assert {r["edge_id"]: (r["target_symbol_id"], r["confidence"], r["is_resolved"]) for r in twice.collect()} == got


def test_neighbours_keep_parallel_edges(spark):
    edges = spark.createDataFrame([("a", 1, 2, "calls"), ("b", 1, 2, "calls"), ("c", 1, 3, "imports"), ("d", 2, 1, "calls")], "edge_id string, source_symbol_id int, target_symbol_id int, kind string")
    seeds = spark.createDataFrame([(1,)], "symbol_id int")
    assert sorted(r["edge_id"] for r in graph.neighbours(edges, seeds).collect()) == ["a", "b"]
    assert [r["edge_id"] for r in graph.neighbours(edges, seeds, incoming=True).collect()] == ["d"]


PATCH = """diff --git a/old.py b/new.py
rename from old.py
rename to new.py
--- a/old.py
+++ b/new.py
@@ -1,2 +1,3 @@ def f
 a
-b
+c
+d
--- /dev/null
+++ b/fresh.py
@@ -0,0 +1,1 @@
+x
--- a/gone.py
+++ /dev/null
@@ -1,1 +0,0 @@
-x
"""


def test_patches(spark):
    df = spark.createDataFrame([("p", PATCH), ("empty", ""), ("broken", "--- a/x\n+++ b/x\n@@ -1,5 +1,5 @@\n a\n")], "patch_id string, patch string")
    files = patches.parse_patches(df).collect()
    got = {(r["path"], r["previous_path"], r["change_type"], r["added_lines"], r["removed_lines"]) for r in files if r["patch_id"] == "p"}
    assert got == {("new.py", "old.py", "renamed", 2, 1), ("fresh.py", None, "added", 1, 0), ("gone.py", None, "deleted", 0, 1)}
    assert [r["error"] is not None for r in files if r["patch_id"] == "broken"] == [True]
    assert not [r for r in files if r["patch_id"] == "empty"]
    parsed = patches.parse_patches(df.filter("patch_id = 'p'"))
    hunks = patches.hunks_of(parsed)
    assert {r["path"] for r in lines.reviewable(parsed, hunks).collect()} == {"new.py", "fresh.py"}
    again = lines.unified_patch(parsed, hunks).withColumnRenamed("path", "patch_id")
    assert {(r["path"], r["added_lines"], r["removed_lines"]) for r in patches.parse_patches(again).collect()} == {(a, c, d) for a, _, _, c, d in got}


def test_patch_corners(spark):
    """Lines that look like headers inside a hunk, counts left out, markers of missing line ends, and broken hunks."""
    rows = [
        ("inner", "--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n--- old name\n+++ new name\n-- y\n\\ No newline at end of file\n+z\n--- a/y\t2024\n+++ b/y\n@@ -3 +3 @@ def g\n-a\n+b"),
        ("mode", "diff --git a/run.sh b/run.sh\nold mode 100644\nnew mode 100755\ndiff --git a/q b/r\nrename from q\nrename to r\n"),
        ("orphan", "@@ -1 +1 @@\n-a\n+b\n"), ("long", "--- a/x\n+++ b/x\n@@ -1,1 +1,2 @@\n+a\n+b\n c\n"), ("longer", "--- a/x\n+++ b/x\n@@ -1,2 +1,1 @@\n-a\n+b\n c\n"), ("null", None),
        ("stray", "--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n a\nnot of a hunk\n b\n c\n"), ("blank", "--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n a\n\n c\n"),
    ]
    got = {}
    for r in patches.parse_patches(spark.createDataFrame(rows, "patch_id string, patch string")).collect():
        got.setdefault(r["patch_id"], []).append((r["path"], r["change_type"], r["added_lines"], r["removed_lines"], r["error"], len(r["hunks"])))
    short, long = "a hunk is shorter than its header says", "a hunk is longer than its header says"
    assert sorted(got["inner"]) == [("x", "modified", 2, 2, None, 1), ("y", "modified", 1, 1, None, 1)]
    assert sorted(got["mode"]) == [("r", "renamed", 0, 0, None, 0), ("run.sh", "modified", 0, 0, None, 0)]
    assert {k: got[k][0][4] for k in ("orphan", "long", "longer", "stray")} == {"orphan": "a hunk without a file", "long": long, "longer": long, "stray": short}
    assert got["blank"] == [("x", "modified", 0, 0, None, 1)] and "null" not in got


SOURCE = '''from decimal import Decimal
from store import Repository as Store


class BaseBuilder:
    pass


@register
class ReportBuilder(BaseBuilder):
    @property
    def total(self):
        return self.normalize(len([1]))

    def build(self, repo: Store):
        if not repo:
            raise ValueError("x")
        return Store.load(Decimal(1))
'''


def test_parsing(spark):
    files = spark.createDataFrame([("app/report.py", "python", SOURCE), ("bad.py", "python", "def ("), ("a.md", "markdown", "# T\n\ntext")], "path string, language string, content string")
    kinds = {(r["qualified_name"], r["kind"]) for r in parsing.symbols(parsing.parse(files)).collect()}
    assert {("app.report", "module"), ("app.report.ReportBuilder", "class"), ("app.report.ReportBuilder.total", "property"), ("app.report.ReportBuilder.build", "method"), ("bad", "module"), ("a", "module")} <= kinds
    edges = {(r["source_qualified_name"], r["target_qualified_name"], r["kind"]) for r in parsing.edges(parsing.parse(files)).collect()}
    me = "app.report.ReportBuilder"
    assert (me, "app.report.BaseBuilder", "inherits") in edges and (me + ".build", "decimal.Decimal", "calls") in edges
    assert (me + ".build", "store.Repository.load", "calls") in edges and (me + ".build", "ValueError", "raises") in edges
    assert (me + ".build", "ValueError", "calls") not in edges and not any(t == "len" for _, t, _ in edges)
    assert (me + ".total", me + ".normalize", "calls") in edges and (me, "register", "decorates") in edges
    chunk = [r for r in parsing.chunks(parsing.parse(files)).collect() if r["path"] == "app/report.py"]
    covered = {n for r in chunk for n in range(r["start_line"], r["end_line"] + 1)}
    assert all(n in covered for n, line in enumerate(SOURCE.split("\n"), 1) if line.strip())


def packed(text):
    """Chunks of a text by a plain loop."""
    out, first, used = [], 1, 0
    lines_ = text.split("\n")
    for n, line in enumerate(lines_, 1):
        used += len(line) + 1
        size = max(1, round(used / 3.0))
        if size >= 800 or (size >= 400 and n - first + 1 >= 3 and not line.strip()):
            out.append((first, n))
            first, used = n + 1, 0
    out += [(first, len(lines_))] if first <= len(lines_) else []
    return [(a, b) for a, b in out if "\n".join(lines_[a - 1 : b]).strip()]


def test_text_chunks_match_a_loop(spark):
    import random

    rng = random.Random(4)
    texts = ["\n".join("ab " * rng.choice([0, 0, 1, 20, 90, 300, 900]) for _ in range(rng.randrange(60))) for _ in range(60)] + ["", "\n\n", " "]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    got = {}
    for r in packing.text_chunks(files).orderBy("start_line").collect():
        got.setdefault(int(r["path"]), []).append((r["start_line"], r["end_line"]))
    assert [got.get(i, []) for i in range(len(texts))] == [packed(t) for t in texts]


def test_files_that_break_the_parser_are_text(spark):
    deep = "if a:\n  pass\n" + "elif a:\n  pass\n" * 3000
    files = spark.createDataFrame([("deep.py", "python", deep), ("m.py", "python", "match x:\n    case 1:\n        def f():\n            pass\n")], "path string, language string, content string")
    names = {r["qualified_name"] for r in parsing.symbols(parsing.parse(files)).collect()}
    assert names == {"deep", "m", "m.f"}


def test_script_owners_and_calls(spark):
    text = "import x from './x'\nclass A {\n  go() {\n    const g = () => { x(); };\n    g();\n    this.stop(\"}{\");\n  }\n  stop() {\n    if (1) {\n    }\n  }\n}\nfunction f() {\n  // stop() {\n  return A.go();\n}\n"
    files = spark.createDataFrame([("src/a/index.ts", "typescript", text)], "path string, language string, content string")
    spans = {r["qualified_name"]: (r["start_line"], r["end_line"]) for r in scripts.symbols(files).collect()}
    assert spans == {"a": (1, 17), "a.A": (2, 12), "a.A.go": (3, 7), "a.A.go.g": (4, 4), "a.A.stop": (8, 11), "a.f": (13, 16)}
    found = {(r["source_qualified_name"], r["target_qualified_name"]) for r in scripts.edges(files).filter("kind = 'calls'").collect()}
    assert found == {("a.A.go.g", "x"), ("a.A.go", "g"), ("a.A.go", "a.A.stop"), ("a.f", "A.go")}


def test_tree_diff(spark):
    old = spark.createDataFrame([("same", "1"), ("edited", "1"), ("gone", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("same", "1"), ("edited", "2"), ("fresh", "1")], "path string, content_hash string")
    assert {(r["path"], r["action"]) for r in index.tree_diff(old, new).collect()} == {("same", "unchanged"), ("edited", "changed"), ("gone", "vanished"), ("fresh", "new")}


def test_feedback_latest_wins(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    findings = spark.createDataFrame([(1,), (2,), (3,)], "finding_id int")
    marks = spark.createDataFrame([(1, 1, "useful", at(1)), (2, 2, "useful", at(1)), (3, 2, "false_positive", at(2))], "feedback_id int, finding_id int, verdict string, created_at timestamp")
    r = digests.feedback_digest(findings, marks).first()
    assert (r["total_findings"], r["marked_count"], r["useful"], r["false_positive"], r["useful_share"]) == (3, 2, 1, 1, 0.5)
    none = digests.feedback_digest(findings, marks.limit(0)).first()
    assert none["useful_share"] is None and none["marked_count"] == 0


def test_gate_quirk(spark):
    none = spark.createDataFrame([], "severity string, status string")
    assert digests.fails_gate(none, "nitpick").first()[0] is True
    assert digests.fails_gate(none, "minor").first()[0] is False


def test_review_outcomes(spark):
    base = dict(run_id="r", category="bug", body="", anchor_symbol=None, evidence=None)
    rows = [
        dict(draft_id="a", seq=1, file_path="f", line_start=2, line_end=3, severity="minor", title="t", code_fragment="x  =  1"),
        dict(draft_id="b", seq=2, file_path="f", line_start=2, line_end=3, severity="major", title="t", code_fragment="x = 1"),
        dict(draft_id="c", seq=3, file_path="f", line_start=90, line_end=91, severity="major", title="u", code_fragment="y = 2"),
        dict(draft_id="d", seq=4, file_path="f", line_start=2, line_end=3, severity="major", title="v", code_fragment="made up"),
        dict(draft_id="e", seq=5, file_path="f", line_start=2, line_end=3, severity="major", title="breaks every caller", code_fragment="y = 2"),
    ]
    schema = "draft_id string, run_id string, seq int, file_path string, line_start int, line_end int, severity string, category string, title string, body string, anchor_symbol string, code_fragment string, evidence array<string>"
    names = [x.split()[0] for x in schema.split(", ")]
    drafts = spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], schema)
    sources = spark.createDataFrame([("f", 0, "quoted_code", "+x = 1\n+y = 2")], "file_path string, source_no int, kind string, text string")
    hunks = spark.createDataFrame([("f", 1, 10)], "file_path string, first int, last int")
    shown = spark.createDataFrame([], "file_path string")
    got = {r["draft_id"]: r["outcome"] for r in review.verify(drafts, sources, hunks, shown).collect()}
    assert got == {"a": "duplicate", "b": "finding", "c": "outside_diff", "d": "without_evidence", "e": "unproven"}
    seen = spark.createDataFrame([("f",)], "file_path string")
    assert {r["draft_id"]: r["outcome"] for r in review.verify(drafts, sources, hunks, seen).collect()}["e"] == "finding"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), max_size=12))
def test_budget_is_never_exceeded(spark, sizes):
    pieces = spark.createDataFrame([("k", str(i), i, n) for i, n in enumerate(sizes)], "key string, piece_id string, place int, tokens int")
    used, taken, dropped = 0, [], 0
    for i, n in enumerate(sizes):
        if used + n <= 50:
            used, taken = used + n, [*taken, str(i)]
        else:
            dropped += 1
    got = review.take_within_budget(pieces, "key", ["place"], 50).first()
    assert (got is None and not sizes) or (got["used"], got["taken"], got["dropped"]) == (used, taken, dropped)


def test_eval_matching(spark):
    cases = spark.createDataFrame([("sql", ["injection"], "security", "major"), ("clean", [], None, None)], "name string, keywords array<string>, category string, min_severity string")
    found = spark.createDataFrame([("sql", "SQL Injection", "x", "critical", "security"), ("clean", "noise", "", "minor", "style")], "name string, title string, body string, severity string, category string")
    rows = review.match_expected(cases, found).withColumn("failed", F.lit(False)).withColumn("with_context", F.lit(True))
    m = digests.eval_metrics(rows).first()
    assert (m["recall"], m["false_alarm_rate"], m["severity_accuracy"], m["findings_on_clean"]) == (1.0, 1.0, 1.0, 1)


def test_passages_by_stems(spark):
    text = "Требование 3.2. Печать справки\n\nСправка печатается в PDF.\n\nДругое."
    d = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    got = [r["text"] for r in documents.select_passages(documents.passages(d, "id", "text"), "id", "как печатается справка").orderBy("number").collect()]
    assert got[0].startswith("Требование") and "PDF" in got[0]
    assert documents.select_passages(documents.passages(d, "id", "text"), "id", "qqq").count() == 0


def test_overlap_join_is_exact(spark):
    import random

    rng = random.Random(1)
    make = lambda n: [(rng.choice("ab"), i, s, s + rng.randrange(90)) for i in range(n) for s in [rng.randrange(400)]]
    left, right = make(60), make(60)
    a = spark.createDataFrame(left, "k string, l int, l_start int, l_end int")
    b = spark.createDataFrame(right, "k string, r int, r_start int, r_end int")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= y[3] and x[3] >= y[2])
    assert sorted((r["l"], r["r"]) for r in lines.overlap_join(a, b, "k", bin_lines=16).collect()) == want


def test_tenant_without_a_name_sees_nothing(spark):
    t = spark.createDataFrame([("t1", 1)], "tenant_id string, id int")
    child = spark.createDataFrame([(1, 5)], "parent int, own int")
    assert [x.count() for x in filters.scoped_to_tenant(t, "t1", (child, "parent", "id"))] == [1, 1]
    assert [x.count() for x in filters.scoped_to_tenant(t, None, (child, "parent", "id"))] == [0, 0]


def test_log_lines(spark):
    rows = [(1, '{"level":"error","event":"x","k":"v"}'), (2, "not json"), (3, '{"level":"info","event":"y"}'), (4, '{"level":"critical","event":"z","logger":"app.q"}')]
    lines_ = spark.createDataFrame(rows, "number int, value string")
    assert [r["number"] for r in sources.log_tail(lines_, 5, min_level="error").collect()] == [1, 4]
    assert [r["number"] for r in sources.log_tail(lines_, 1).collect()] == [4]
    assert sources.parse_log(lines_).filter("number = 1").first()["fields"] == {"k": "v"}


def test_step_stream_drops_repeats(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i % 5, "r", "f", i, "k", "t", "{}", "d", 1, False, at) for i in range(10)]
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.createDataFrame(rows, steps.STEP).write.parquet(src)
    told = []
    q = steps.record(steps.live_steps(steps.read_steps(spark, src)), out, check, lambda b: told.append(b.count()))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 5 and sum(told) == 5


def test_tree_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("print(1)\n")
    (tmp_path / "Makefile").write_text("all:\n")
    assert {(r["path"], r["language"]) for r in sources.tree(spark, str(tmp_path)).collect()} == {("a/x.py", "python"), ("Makefile", "make")}
