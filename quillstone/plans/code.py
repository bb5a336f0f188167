"""Queries of the symbol graph, incremental indexing, patches, parsing and the review dataflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import graph, index, lines, packing, review, snippets, sweep
from quillstone.plans import bindings as B
from quillstone.plans.registry import query
from quillstone.session import many_tasks, table
from quillstone.sources import files as file_sources
from quillstone.sources import patches
from quillstone.storage import kept

RESOLVED = f"""WITH {B.EDGES}, full_names AS (SELECT qualified_name, arg_min(symbol_id, (start_line, symbol_id)) AS target FROM symbols GROUP BY 1 HAVING count(DISTINCT file_id) = 1),
short_names AS (SELECT regexp_replace(qualified_name, '^.*\\.', '') AS target_name, min(symbol_id) AS target FROM symbols WHERE kind <> 'module' GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT edge_id, e.kind, e.confidence AS c0, e.target_symbol_id AS t0, f.target AS tf, s.target AS ts FROM edges e LEFT JOIN full_names f ON f.qualified_name = e.target_qualified_name
  LEFT JOIN short_names s ON s.target_name = regexp_replace(e.target_qualified_name, '^.*\\.', ''))
SELECT edge_id, kind, coalesce(t0, tf, ts) AS target_symbol_id, CASE WHEN t0 IS NULL AND tf IS NULL AND ts IS NOT NULL THEN 0.3 ELSE c0 END AS confidence, coalesce(t0, tf, ts) IS NOT NULL AS is_resolved FROM r"""


@query("i12_resolve_edges", RESOLVED)
def _(spark, sf):
    out = graph.resolve_edges(B.edges(spark, sf), B.symbols(spark, sf))
    return out.select("edge_id", "kind", "target_symbol_id", "confidence", "is_resolved")


@query("a8_unique_names", f"WITH {B.SYMBOLS} SELECT qualified_name, arg_min(symbol_id, (start_line, symbol_id)) AS target FROM symbols GROUP BY 1 HAVING count(DISTINCT file_id) = 1")
def _(spark, sf):
    return graph.unique_names(B.symbols(spark, sf))


@query("a9_singletons", f"WITH {B.SYMBOLS} SELECT regexp_replace(qualified_name, '^.*\\.', '') AS target_name, min(symbol_id) AS target FROM symbols WHERE kind <> 'module' GROUP BY 1 HAVING count(*) = 1")
def _(spark, sf):
    return graph.singleton_segments(B.symbols(spark, sf))


@query("a5_resolved", f"WITH {B.EDGES} SELECT count(*) AS edges, count(target_symbol_id) AS resolved FROM edges")
def _(spark, sf):
    return graph.resolved_count(B.edges(spark, sf))


SEEDS = "seeds AS (SELECT s_suppkey AS symbol_id FROM supplier WHERE s_acctbal > 8000)"


def seeds(spark, sf):
    return table(spark, sf, "supplier").filter("s_acctbal > 8000").select(F.col("s_suppkey").alias("symbol_id"))


@query("r19_callers", f"WITH {B.EDGES}, {SEEDS} SELECT e.edge_id, source_symbol_id AS neighbour_id, s.qualified_name, e.confidence FROM edges e JOIN symbols s ON s.symbol_id = e.source_symbol_id WHERE e.kind = 'calls' AND target_symbol_id IN (SELECT symbol_id FROM seeds) AND source_symbol_id NOT IN (SELECT symbol_id FROM seeds) ORDER BY e.confidence DESC, neighbour_id, edge_id LIMIT 50")
def _(spark, sf):
    s = B.symbols(spark, sf)
    files = s.select("file_id").distinct().withColumn("path", F.col("file_id"))
    found = graph.neighbours(B.edges(spark, sf), seeds(spark, sf), incoming=True)
    return graph.with_symbols(found, s, files, 50).select("edge_id", "neighbour_id", "qualified_name", "confidence")


@query("r19_callees", f"WITH {B.EDGES}, {SEEDS} SELECT edge_id, kind, target_symbol_id AS neighbour_id FROM edges WHERE target_symbol_id IS NOT NULL AND source_symbol_id IN (SELECT symbol_id FROM seeds) AND target_symbol_id NOT IN (SELECT symbol_id FROM seeds)")
def _(spark, sf):
    return graph.neighbours(B.edges(spark, sf), seeds(spark, sf), kinds=()).select("edge_id", "kind", "neighbour_id")


@query("r21_edge_kinds", f"WITH {B.EDGES}, {SEEDS} SELECT kind, count(*) AS n FROM edges WHERE target_symbol_id IN (SELECT symbol_id FROM seeds) AND source_symbol_id NOT IN (SELECT symbol_id FROM seeds) GROUP BY kind")
def _(spark, sf):
    return graph.edge_kinds(B.edges(spark, sf), seeds(spark, sf))


@query("i11_replace_edges", f"WITH {B.EDGES} SELECT edge_id, source_symbol_id, kind FROM edges WHERE source_symbol_id NOT IN (SELECT source_symbol_id FROM edges WHERE confidence > 0.95 AND kind = 'calls') UNION ALL SELECT edge_id, source_symbol_id, kind FROM edges WHERE confidence > 0.95 AND kind = 'calls'")
def _(spark, sf):
    e = B.edges(spark, sf).select("edge_id", "source_symbol_id", "kind", "confidence")
    parsed = e.filter("confidence > 0.95 AND kind = 'calls'").drop("confidence")
    return graph.replace_edges(e.drop("confidence"), parsed).select("edge_id", "source_symbol_id", "kind")


REACH = f"""WITH RECURSIVE {B.EDGES}, links AS (SELECT DISTINCT source_symbol_id AS node, target_symbol_id AS nxt FROM edges WHERE target_symbol_id IS NOT NULL), start AS (SELECT p_partkey AS node FROM part WHERE p_retailprice < 901),
walk(node, hop) AS (SELECT node, 0 FROM start UNION SELECT l.nxt, w.hop + 1 FROM walk w JOIN links l USING (node) WHERE w.hop < 2)
SELECT node, min(hop) AS hop FROM walk GROUP BY node"""


@query("ext_reachable", REACH)
def _(spark, sf):
    start = table(spark, sf, "part").filter("p_retailprice < 901").select(F.col("p_partkey").alias("symbol_id"))
    return graph.reachable(B.edges(spark, sf), start, 2)


DIFF = "old AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents WHERE n_chars > 100), new AS (SELECT doc_id::VARCHAR AS path, CASE WHEN lang = 'fr' THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE n_chars < 5000)"
ACTION = "CASE WHEN n.h IS NULL THEN 'vanished' WHEN o.h IS NULL THEN 'new' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END"


def trees(spark, sf):
    d = table(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string"))
    old = d.filter("n_chars > 100").select("path", T.content_hash(F.col("text")).alias("content_hash"))
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return old, d.filter("n_chars < 5000").select("path", T.content_hash(text).alias("content_hash"))


@query("j20_i1_tree_diff", f"WITH {DIFF} SELECT coalesce(o.path, n.path) AS path, {ACTION} AS action FROM old o FULL JOIN new n USING (path)")
def _(spark, sf):
    return index.tree_diff(*trees(spark, sf))


@query("a22_build_counters", f"WITH {DIFF}, a AS (SELECT {ACTION} AS x FROM old o FULL JOIN new n USING (path)) SELECT count(*) FILTER (x IN ('changed', 'new')) AS parsed, count(*) FILTER (x = 'unchanged') AS reused, count(*) FILTER (x <> 'vanished') AS stored, count(*) FILTER (x = 'vanished') AS deleted FROM a")
def _(spark, sf):
    return index.build_counters(index.tree_diff(*trees(spark, sf)))


@query("s18_insert_missing", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE NOT c_acctbal > 0")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return index.insert_missing(c.filter("c_acctbal > 0").select("c_custkey", "c_name"), c.select("c_custkey", F.lit("new").alias("c_name")), ["c_custkey"])


@query("s22_cascade", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    dead = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return index.cascade(dead, "c_custkey", [(o, "o_custkey", "o_orderkey"), (li, "l_orderkey", "l_partkey")])[1].select("l_orderkey", "l_linenumber", "l_partkey")


@query("i24_nested", "SELECT o_orderkey, count(l_orderkey) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    joined = index.nested(o, li, "o_orderkey", "items", ["l_linenumber", "l_partkey"])
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return joined.select("o_orderkey", F.size("items").cast("long").alias("n"), F.when(F.size("items") > 0, text).alias("items"))


RANGES = f"WITH {B.SYMBOLS}"


@query("j14_overlap_join", f"{RANGES}, h AS (SELECT p_brand AS file_id, p_partkey AS hunk_id, p_size AS l_start, p_size + 3 AS l_end FROM part) SELECT hunk_id, symbol_id FROM h JOIN symbols s ON h.file_id = s.file_id AND l_start <= end_line AND l_end >= start_line WHERE kind <> 'module'")
def _(spark, sf):
    h = table(spark, sf, "part").select(F.col("p_brand").alias("file_id"), F.col("p_partkey").alias("hunk_id"), F.col("p_size").alias("l_start"), (F.col("p_size") + 3).alias("l_end"))
    s = B.symbols(spark, sf).filter("kind <> 'module'").select("file_id", "symbol_id", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    return lines.overlap_join(h, s, "file_id", bin_lines=16).select("hunk_id", "symbol_id")


@query("j18_innermost", f"{RANGES}, p AS (SELECT p_brand AS file_id, p_partkey AS point_id, p_size + 5 AS place FROM part), r AS (SELECT p.file_id, point_id, symbol_id, row_number() OVER (PARTITION BY p.file_id, point_id ORDER BY start_line DESC, end_line, symbol_id) AS rn FROM p JOIN symbols s ON p.file_id = s.file_id AND place BETWEEN start_line AND end_line) SELECT file_id, point_id, symbol_id AS range_id FROM r WHERE rn = 1")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("file_id"), F.col("p_partkey").alias("point_id"), (F.col("p_size") + 5).alias("at"))
    s = B.symbols(spark, sf).select("file_id", F.col("symbol_id").alias("range_id"), F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    return sweep.innermost(s, p, "file_id")


@query("s9_parse_patches", "SELECT doc_id::VARCHAR AS patch_id, source || '/' || doc_id || '.md' AS path, 'added' AS change_type, len(string_split(text, chr(10)))::INT AS added_lines, 0 AS removed_lines, NULL::VARCHAR AS error, 1 AS hunks FROM documents")
def _(spark, sf):
    """Patches made of documents' lines, parsed again."""
    d = table(spark, sf, "documents")
    n = F.size(F.split("text", "\n"))
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("+"), x)), "\n")
    name = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    patch = F.concat(F.lit("--- /dev/null\n+++ b/"), name, F.lit(".md\n@@ -0,0 +1,"), n.cast("string"), F.lit(" @@\n"), body, F.lit("\n"))
    files = patches.parse_patches(d.select(F.col("doc_id").cast("string").alias("patch_id"), patch.alias("patch")))
    return files.select("patch_id", "path", "change_type", "added_lines", "removed_lines", "error", F.size("hunks").alias("hunks"))


@query("d1_added_code", "SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: x[2:]), chr(10)) AS added FROM (SELECT doc_id, '+' || replace(text, chr(10), chr(10) || '-') AS text FROM documents)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("+"), F.replace("text", F.lit("\n"), F.lit("\n-"))).alias("text"))
    return d.select("doc_id", T.added_code(F.col("text")).alias("added"))


PACKED = f"""WITH RECURSIVE {B.FILES}, l AS (SELECT path, string_split(content, chr(10)) AS s FROM files),
walk(path, s, n, first, used, cut) AS (SELECT path, s, 0, 1, 0::BIGINT, false FROM l UNION ALL
  SELECT path, s, n + 1, CASE WHEN cut THEN n + 1 ELSE first END, u, greatest(1, round_even(u / 3.0, 0)) >= 800 OR (greatest(1, round_even(u / 3.0, 0)) >= 400 AND n + 2 - CASE WHEN cut THEN n + 1 ELSE first END >= 3 AND regexp_matches(s[n + 1], '^\\s*$'))
  FROM (SELECT *, CASE WHEN cut THEN 0 ELSE used END + length(s[n + 1]) + 1 AS u FROM walk WHERE n < len(s))),
c AS (SELECT path, first AS start_line, n AS end_line, array_to_string(s[first:n], chr(10)) AS content FROM walk WHERE n > 0 AND (cut OR n = len(s)))
SELECT path, start_line, end_line, greatest(1, round_even(length(content) / 3.0, 0)::INT) AS token_count FROM c WHERE regexp_matches(content, '\\S')"""


@query("i6_text_chunks", PACKED)
def _(spark, sf):
    return packing.text_chunks(B.files(spark, sf)).select("path", "start_line", "end_line", "token_count")


DRAFTS = """drafts AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS draft_id, l_orderkey AS run_id, l_shipdate, 'f' || l_returnflag AS file_path, l_linenumber * 3 AS line_start, l_linenumber * 3 + 1 AS line_end,
  CASE WHEN l_discount > 0.08 THEN 'critical' WHEN l_discount > 0.05 THEN 'major' ELSE 'minor' END AS severity, l_linestatus AS category, CASE WHEN l_tax > 0.06 THEN 'breaks every caller' ELSE 'local' END AS title, '' AS body,
  CASE WHEN l_quantity > 10 THEN 'quoted   code ' || l_returnflag ELSE 'made up' END AS fragment FROM lineitem)"""


def draft_rows(lineitem):
    return lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("draft_id"), F.col("l_orderkey").alias("run_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        F.concat(F.lit("f"), "l_returnflag").alias("file_path"), (F.col("l_linenumber") * 3).alias("line_start"), (F.col("l_linenumber") * 3 + 1).alias("line_end"),
        F.when(F.col("l_discount") > 0.08, "critical").when(F.col("l_discount") > 0.05, "major").otherwise("minor").alias("severity"), F.col("l_linestatus").alias("category"),
        F.when(F.col("l_tax") > 0.06, "breaks every caller").otherwise("local").alias("title"), F.lit("").alias("body"), F.lit(None).cast("string").alias("anchor_symbol"),
        F.when(F.col("l_quantity") > 10, F.concat(F.lit("quoted   code "), "l_returnflag")).otherwise("made up").alias("code_fragment"), F.lit(None).cast("array<string>").alias("evidence"),
    )


def drafts(spark, sf):
    """Drafts of lines, dealt by run: an order has few lines. Of lines with the same number the most severe one counts."""
    keys, rest = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus"]
    li = table(spark, sf, "lineitem").select(*keys, *rest).repartition(many_tasks(spark), "l_orderkey")
    return draft_rows(li.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_x")).select(*keys, "_x.*"))


VERIFIED = f"""WITH {DRAFTS}, d0 AS (SELECT DISTINCT * FROM (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY severity) AS q FROM drafts) WHERE q = 1),
j AS (SELECT draft_id, run_id, file_path, severity, category, line_start <= 15 AS covers_line, fragment LIKE 'quoted%' AND file_path <> 'fR' AS has_evidence, title = 'local' OR file_path = 'fN' AS proven, category || file_path || fragment AS key, draft_id AS seq FROM d0),
m AS (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY covers_line DESC, (has_evidence AND proven) DESC, CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 ELSE 1 END DESC, seq) > 1 AS displaced FROM j)
SELECT run_id, count(*) FILTER (o = 'outside_diff') AS outside_diff, count(*) FILTER (o = 'without_evidence') AS without_evidence, count(*) FILTER (o = 'unproven') AS unproven, count(*) FILTER (o = 'duplicate') AS duplicate, count(*) FILTER (o = 'finding') AS findings
FROM (SELECT run_id, CASE WHEN NOT covers_line THEN 'outside_diff' WHEN displaced AND has_evidence AND proven THEN 'duplicate' WHEN NOT has_evidence THEN 'without_evidence' WHEN NOT proven THEN 'unproven' ELSE 'finding' END AS o FROM m) GROUP BY run_id"""


def draft_context(spark, sf):
    """Drafts with the sources, hunks and shown files of their three files."""
    # Read several times: for evidence, for the drafts of each file and for their outcome.
    return kept(drafts(spark, sf), "drafts"), *file_context(spark, sf)


def file_context(spark, sf):
    flags = kept(table(spark, sf, "lineitem").select(F.concat(F.lit("f"), "l_returnflag").alias("file_path")).distinct(), "flags")
    sources = flags.filter("file_path <> 'fR'").select("file_path", F.lit(0).alias("source_no"), F.lit("quoted_code").alias("kind"), F.concat(F.lit("x quoted code "), F.substring("file_path", 2, 1)).alias("text"))
    hunks = flags.select("file_path", F.lit(1).alias("first"), F.lit(15).alias("last"))
    return sources, hunks, flags.filter("file_path = 'fN'")


@query("d8_d9_a28_verify", VERIFIED)
def _(spark, sf):
    """Lines are shuffled once, by run; what they quote is read from the table as it lies."""
    return review.discard_counts(review.verify(drafts(spark, sf), *file_context(spark, sf), quoted=draft_rows(table(spark, sf, "lineitem"))))


SNIPPETS = f"""WITH {B.FILES}, n AS (SELECT file_id, language, trim(regexp_replace(content, '\\s+', ' ', 'g'), ' ') AS t FROM files),
q AS (SELECT DISTINCT language, t[1 + file_id % 40:file_id % 40 + 1 + file_id % 45] AS s FROM n) SELECT q.language AS file_path, s AS snippet, min(file_id) AS source_no FROM q JOIN n ON n.language = q.language AND contains(t, s) WHERE s <> '' GROUP BY 1, 2"""


@query("j16_d10_snippets", SNIPPETS)
def _(spark, sf):
    """A stretch of every file against all files of its language."""
    f = B.files(spark, sf).select(F.col("language").alias("file_path"), F.col("file_id").alias("source_no"), F.lit("file").alias("kind"), T.normal_space(F.col("content")).alias("text"))
    at = F.col("source_no") % 40 + 1
    # A stretch ends at the 84th character at most, so the first ones of a text do, but for many blanks.
    head = T.normal_space(F.substring("content", 1, 400))
    begun = B.files(spark, sf).select(F.col("language").alias("file_path"), F.col("file_id").alias("source_no"), F.when((F.col("file_id") >= 0) & (F.length(head) >= 84), head).otherwise(T.normal_space(F.col("content"))).alias("text"))
    asked = begun.select("file_path", F.substring("text", at, F.col("source_no") % 45 + 1).alias("snippet"))
    return snippets.first_sources(asked, f).select("file_path", "snippet", "source_no")


BUDGET = """WITH RECURSIVE p AS (SELECT l_orderkey AS key, l_linenumber || '-' || l_partkey AS piece_id, min((l_linenumber, l_quantity::INT)) AS x FROM lineitem GROUP BY 1, 2),
r AS (SELECT key, piece_id, x[2] AS tokens, row_number() OVER (PARTITION BY key ORDER BY x[1], piece_id, x[2]) AS i, count(*) OVER (PARTITION BY key) AS n FROM p),
walk(key, i, n, used, taken, dropped) AS (SELECT DISTINCT key, 0::BIGINT, n, 0::BIGINT, '', 0 FROM r UNION ALL
  SELECT w.key, r.i, w.n, CASE WHEN used + tokens <= 60 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 60 THEN taken || CASE WHEN taken = '' THEN '' ELSE ',' END || piece_id ELSE taken END, CASE WHEN used + tokens <= 60 THEN dropped ELSE dropped + 1 END
  FROM walk w JOIN r ON r.key = w.key AND r.i = w.i + 1)
SELECT key, used, taken, dropped FROM walk WHERE i = n"""


@query("r28_budget", BUDGET)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("piece_id"), F.col("l_linenumber").alias("origin"), F.col("l_quantity").cast("int").alias("tokens"))
    return review.take_within_budget(li, "key", ["origin"], 60).withColumn("taken", F.array_join("taken", ","))


@query("d6_plan_mode", "SELECT doc_id::VARCHAR AS path, length(text) AS chars, CASE WHEN length(text) <= 12000 THEN 'agentic' ELSE 'single_pass' END AS mode FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("patch_text"))
    return review.plan_mode(d, agentic=True)


@query("d7_x7_fan_out", "SELECT path, reviewer FROM (SELECT doc_id::VARCHAR AS path, CASE WHEN length(text) <= 12000 THEN 'agentic' ELSE 'single_pass' END AS mode, lang FROM documents) JOIN (VALUES ('a', 'agentic'), ('b', 'agentic'), ('c', 'single_pass')) r(reviewer, mode) USING (mode) WHERE NOT (lang = 'fr' AND reviewer = 'a')")
def _(spark, sf):
    d = table(spark, sf, "documents")
    mode = F.when(F.length("text") <= 12000, "agentic").otherwise("single_pass")
    files = d.select(F.col("doc_id").cast("string").alias("path"), mode.alias("mode"))
    done = d.filter("lang = 'fr'").select(F.col("doc_id").cast("string").alias("path"), F.lit("a").alias("reviewer"))
    reviewers = spark.createDataFrame([("a", "agentic"), ("b", "agentic"), ("c", "single_pass")], "reviewer string, mode string")
    return review.fan_out(files, reviewers, done).select("path", "reviewer")


@query("d17_j22_match_expected", "SELECT c.item_id::VARCHAR AS name, bool_or(d.doc_id IS NOT NULL AND contains(lower(d.text), lower(k))) AS found, count(d.doc_id) AS findings FROM (SELECT item_id, string_split(text, ' ')[2] AS k FROM benchmark) c LEFT JOIN documents d ON d.doc_id = c.item_id GROUP BY 1")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.array(F.split("text", " ")[1]).alias("keywords"), F.lit("bug").alias("category"), F.lit("minor").alias("min_severity"))
    f = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.lit("").alias("title"), F.col("text").alias("body"), F.lit("major").alias("severity"), F.lit("bug").alias("category"))
    return review.match_expected(b, f).select("name", "found", "findings")


@query("s31_s13_log_tail", """SELECT event_id AS number, event_type AS level, user_id::VARCHAR AS logger FROM events WHERE event_type = 'error' AND event_id NOT IN (-1) ORDER BY event_id DESC LIMIT 100""")
def _(spark, sf):
    e = table(spark, sf, "events")
    value = F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("level"), F.col("user_id").cast("string").alias("logger"), F.lit("step").alias("event"), F.col("value").alias("amount")))
    tail = file_sources.log_tail(e.select(F.col("event_id").alias("number"), value.alias("value")), 100, min_level="error")
    return tail.select("number", "level", "logger")
