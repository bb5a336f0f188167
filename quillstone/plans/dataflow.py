"""Queries of indexing and of the review dataflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import filters, index, lines, parsing, review, scripts
from quillstone.plans import bindings as B
from quillstone.plans.registry import query
from quillstone.session import many_tasks, table


@query("i9_breadcrumb", f"WITH {B.SYMBOLS} SELECT symbol_id, split_part(qualified_name, '.', 1) || ' > ' || kind || ' > ' || file_id AS crumb, split_part(qualified_name, '.', 1) || '.' || split_part(qualified_name, '.', 2) AS owner FROM symbols")
def _(spark, sf):
    q = F.col("qualified_name")
    head = F.substring_index(q, ".", 2)
    return B.symbols(spark, sf).select("symbol_id", T.breadcrumb(F.substring_index(q, ".", 1), F.array("kind", "file_id")).alias("crumb"), T.common_owner(F.concat(head, F.lit(".a.x")), F.concat(head, F.lit(".b.x"))).alias("owner"))


@query("i13_moved_state", f"WITH {B.SNAPSHOTS} SELECT snapshot_id, CASE WHEN status IN ('ready', 'failed') THEN status ELSE 'cancelled' END AS status FROM snapshots")
def _(spark, sf):
    from quillstone.functions.constants import TERMINAL_SNAPSHOT

    return B.snapshots(spark, sf).select("snapshot_id", review.moved_state(F.col("status"), F.lit("cancelled"), TERMINAL_SNAPSHOT).alias("status"))


HEADS = "heads AS (SELECT c_custkey AS repository_id, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE 'none' END AS head_sha FROM customer), s AS (SELECT sn.*, o_orderpriority AS commit_sha FROM snapshots sn JOIN orders ON o_orderkey = snapshot_id)"


def heads(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("repository_id"), F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("none").alias("head_sha"))
    return c, B.snapshots(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderpriority").alias("commit_sha")), "snapshot_id")


@query("i20_needs_build", f"WITH {B.SNAPSHOTS}, {HEADS} SELECT repository_id, head_sha FROM heads h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.repository_id = h.repository_id AND (status = 'running' OR (status = 'ready' AND commit_sha = head_sha)))")
def _(spark, sf):
    return index.needs_build(*heads(spark, sf))


@query("i23_pick_up", f"WITH {B.SNAPSHOTS}, {HEADS}, p AS (SELECT repository_id, commit_sha, arg_max((snapshot_id, CASE status WHEN 'running' THEN 'reuse' ELSE 'abort' END), (created_at, snapshot_id)) AS x FROM s WHERE status <> 'ready' GROUP BY 1, 2) SELECT h.repository_id, head_sha AS commit_sha, x[1] AS snapshot_id, coalesce(x[2], 'create') AS action FROM heads h LEFT JOIN p ON p.repository_id = h.repository_id AND commit_sha = head_sha")
def _(spark, sf):
    asked, s = heads(spark, sf)
    state = F.when(F.col("status") == "running", "pending").when(F.col("status") == "failed", "cancelled").otherwise(F.col("status"))
    return index.pick_up(asked.withColumnRenamed("head_sha", "commit_sha"), s.withColumn("status", state))


FILE = "f AS (SELECT doc_id::VARCHAR AS path, source AS file_id, 'old' AS last_seen, n_chars < 200 AS is_deleted, n_chars FROM documents WHERE n_chars > 100), t AS (SELECT doc_id::VARCHAR AS path FROM documents WHERE n_chars < 5000)"


@query(
    "i21_i22_apply_tree",
    f"WITH {FILE} SELECT coalesce(f.path, t.path) AS path, coalesce(file_id, sha256(t.path)) AS file_id, CASE WHEN f.path IS NULL THEN 'new' ELSE 'old' END AS first_seen_snapshot_id, CASE WHEN t.path IS NOT NULL THEN 'new' ELSE 'old' END AS last_seen_snapshot_id, t.path IS NULL AS is_deleted FROM f FULL JOIN t ON f.path = t.path",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("file_id"), T.content_hash(F.col("text")).alias("content_hash"), F.lit("markdown").alias("language"), "n_chars")
    files = d.filter("n_chars > 100").select("path", "file_id", "content_hash", "language", F.lit("old").alias("first_seen_snapshot_id"), F.lit("old").alias("last_seen_snapshot_id"), (F.col("n_chars") < 200).alias("is_deleted"))
    tree = d.filter("n_chars < 5000").select("path", "content_hash")
    done = index.apply_tree(files, index.tree_diff(files, tree), tree, "new")
    return done.select("path", "file_id", "first_seen_snapshot_id", "last_seen_snapshot_id", "is_deleted")


@query("i21_replace_children", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 45")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return index.replace_children(li.select("l_orderkey", "l_linenumber", "l_partkey"), li.filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")


@query("i26_nested_ranges", f"WITH {B.SYMBOLS} SELECT s.symbol_id AS hunk_id, r.symbol_id FROM symbols s JOIN symbols r ON s.file_id = r.file_id AND s.start_line <= r.end_line AND s.end_line >= r.start_line WHERE s.kind = 'class' AND r.kind = 'function'")
def _(spark, sf):
    s = B.symbols(spark, sf)
    left = s.filter("kind = 'class'").select("file_id", F.col("symbol_id").alias("hunk_id"), F.col("start_line").alias("l_start"), F.col("end_line").alias("l_end"))
    return lines.overlap_join(left, s.filter("kind = 'function'").select("file_id", "symbol_id", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end")), "file_id").select("hunk_id", "symbol_id")


@query("r38_backends", "SELECT c_custkey, c_mktsegment AS set_name, b.backend FROM customer LEFT JOIN (SELECT o_orderpriority AS p, min(o_orderkey) AS backend FROM orders GROUP BY 1) b ON b.p = CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'MACHINERY' THEN '2-HIGH' END")
def _(spark, sf):
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "BUILDING").when(F.col("o_orderpriority") == "2-HIGH", "MACHINERY").otherwise("else")
    backends = table(spark, sf, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_orderkey").alias("backend"), name.alias("set_name"))
    return index.choose_backends(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("set_name")), backends).select("c_custkey", "set_name", "backend")


# --- parsing -----------------------------------------------------------------

PYTHON = "import lib.tool as tool\\nfrom base import Root\\n\\n@tool.mark\\nclass Part{n}(Root):\\n    def run(self, x):\\n        if x:\\n            raise ValueError(x)\\n        return self.step(tool.call(x))\\n\\n    @property\\n    def step(self):\\n        return helper\\n\\ndef helper(x):\\n    return len(x)"
SCRIPT = "import { a } from './lib';\\nexport class Part{n} {\\n  run(x) {\\n    if (x) { return this.step(x); }\\n    return helper(x);\\n  }\\n  step(y) { return y; }\\n}\\nexport const helper = (x) => {\\n  return a(x);\\n};\\nfunction plain() { return 1; }\\nplain();"


def code(spark, sf, text: str, language: str, suffix: str):
    """One small file for each part; its number is in it. A part takes few bytes and its file long to parse, so parts are dealt to
    all cores however few splits their table has."""
    key = F.col("p_partkey").cast("string")
    content = F.replace(F.lit(text.replace("\\n", "\n")), F.lit("{n}"), key)
    return table(spark, sf, "part").select("p_partkey").repartition(many_tasks(spark), "p_partkey").select(F.concat(F.lit("src/m"), key, F.lit(suffix)).alias("path"), F.lit(language).alias("language"), content.alias("content"))


def each_part(rows: str, columns: str, suffix: str) -> str:
    """SQL of rows for each part, with {n} for its number."""
    names = columns.split(", ")
    picked = ", ".join(f"replace(x.{c}, '{{n}}', p_partkey::VARCHAR) AS {c}" if not c.endswith("_line") else f"x.{c}" for c in names)
    return f"SELECT 'src/m' || p_partkey || '{suffix}' AS path, {picked} FROM part, (VALUES {rows}) x({columns})"


@query("i2_i7_python_symbols", each_part("('module', 'm{n}', 1, 16), ('class', 'm{n}.Part{n}', 4, 13), ('method', 'm{n}.Part{n}.run', 6, 9), ('property', 'm{n}.Part{n}.step', 11, 13), ('function', 'm{n}.helper', 15, 16)", "kind, qualified_name, start_line, end_line", ".py"))
def _(spark, sf):
    return parsing.symbols(parsing.parse(code(spark, sf, PYTHON, "python", ".py"))).select("path", "kind", "qualified_name", "start_line", "end_line")


@query("i4_i25_python_edges", each_part("('m{n}', 'lib.tool', 'imports'), ('m{n}', 'base.Root', 'imports'), ('m{n}.Part{n}', 'lib.tool.mark', 'decorates'), ('m{n}.Part{n}', 'base.Root', 'inherits'), ('m{n}.Part{n}.run', 'ValueError', 'raises'), ('m{n}.Part{n}.run', 'm{n}.Part{n}.step', 'calls'), ('m{n}.Part{n}.run', 'lib.tool.call', 'calls'), ('m{n}.Part{n}.step', 'property', 'decorates')", "source_qualified_name, target_qualified_name, kind", ".py"))
def _(spark, sf):
    return parsing.edges(parsing.parse(code(spark, sf, PYTHON, "python", ".py"))).select("path", "source_qualified_name", "target_qualified_name", "kind")


@query("i8_python_chunks", each_part("('m{n}', 1, 3), ('m{n}.Part{n}', 4, 13), ('m{n}.helper', 15, 16)", "symbol, start_line, end_line", ".py"))
def _(spark, sf):
    return parsing.chunks(parsing.parse(code(spark, sf, PYTHON, "python", ".py"))).select("path", "symbol", "start_line", "end_line")


@query("i5_i27_script_symbols", each_part("('module', 'm{n}', 1, 13), ('class', 'm{n}.Part{n}', 2, 8), ('method', 'm{n}.Part{n}.run', 3, 6), ('method', 'm{n}.Part{n}.step', 7, 7), ('function', 'm{n}.helper', 9, 11), ('function', 'm{n}.plain', 12, 12)", "kind, qualified_name, start_line, end_line", ".ts"))
def _(spark, sf):
    return scripts.symbols(code(spark, sf, SCRIPT, "typescript", ".ts")).select("path", "kind", "qualified_name", "start_line", "end_line")


@query("i5_script_edges", each_part("('m{n}', './lib', 'imports'), ('m{n}.Part{n}.run', 'm{n}.Part{n}.step', 'calls'), ('m{n}.Part{n}.run', 'helper', 'calls'), ('m{n}.helper', 'a', 'calls'), ('m{n}', 'plain', 'calls')", "source_qualified_name, target_qualified_name, kind", ".ts"))
def _(spark, sf):
    return scripts.edges(code(spark, sf, SCRIPT, "typescript", ".ts"))


# --- review ------------------------------------------------------------------


@query("d12_add_findings", "SELECT o_custkey AS run_id, o_orderpriority AS dedup_key FROM orders GROUP BY 1, 2 HAVING count(*) FILTER (o_orderstatus = 'F') = 0")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("dedup_key"), "o_orderstatus")
    return review.add_findings(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'")).select("run_id", "dedup_key")


@query("d13_failure_kind", "SELECT event_id, CASE event_type WHEN 'error' THEN 'broken' WHEN 'purchase' THEN 'limit' ELSE 'unknown' END AS kind FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", review.failure_kind(F.concat(F.lit("pkg."), "event_type"), {"error": "broken", "purchase": "limit", "pkg.err": "later"}).alias("kind"))


@query("d14_run_outcome", "SELECT l_orderkey AS run_id, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag = 'A') = 0 THEN 'failed' ELSE 'completed' END AS status FROM lineitem GROUP BY 1")
def _(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("failures"), F.count_if(F.col("l_returnflag") == "A").alias("files_read"))
    return review.run_outcome(runs).select("run_id", "status")


@query("d20_included_files", f"WITH {B.FILES} SELECT file_id, path FROM files WHERE regexp_full_match(path, 'src[12]/.*') OR path LIKE '%7.md'")
def _(spark, sf):
    return filters.include_paths(B.files(spark, sf), ("src[12]/*", "*7.md")).select("file_id", "path")


@query("d10_d11_d27_judged", "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS draft_id, l_linenumber * 3 <= 15 AS covers_line, l_quantity > 10 AND l_returnflag <> 'R' AS has_evidence, l_tax <= 0.06 OR l_returnflag = 'N' AS proven FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, first(l_quantity) OVER w AS l_quantity, first(l_returnflag) OVER w AS l_returnflag, first(l_tax) OVER w AS l_tax FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey))")
def _(spark, sf):
    from quillstone.plans.code import draft_context

    d, sources, hunks, shown = draft_context(spark, sf)
    return review.judged(d, review.collect_evidence(d, sources), hunks, shown).select("draft_id", "covers_line", "has_evidence", "proven")


@query("j16_evidence", "SELECT 'f' || l_returnflag AS file_path, count(DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS drafts FROM lineitem WHERE l_quantity > 10 AND l_returnflag <> 'R' GROUP BY 1")
def _(spark, sf):
    from quillstone.plans.code import draft_context

    d, sources, _, _ = draft_context(spark, sf)
    return review.collect_evidence(d, sources).join(d.select("draft_id", "file_path"), "draft_id").groupBy("file_path").agg(F.count_distinct("draft_id").alias("drafts"))
