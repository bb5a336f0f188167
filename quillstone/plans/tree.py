"""Queries of sources, sinks, predicates and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import constants as K
from quillstone.functions import text as T
from quillstone.operators import digests, filters, graph, index, lines, review, windows
from quillstone.plans import bindings as B
from quillstone.plans.registry import query
from quillstone.session import table
from quillstone.sources import files as sources
from quillstone.streaming import steps


@query("s1_listing", "SELECT doc_id::VARCHAR AS path, source AS content_hash FROM documents WHERE lang IN ('de', 'en')")
def _(spark, sf):
    d = table(spark, sf, "documents")
    mode = F.when(F.col("lang") == "en", "100644").when(F.col("lang") == "de", "100755").when(F.col("lang") == "fr", "120000").otherwise("160000")
    return sources.listing(d.select(mode.alias("mode"), F.col("doc_id").cast("string").alias("path"), F.col("source").alias("blob")))


@query("s2_s16_content_at", "SELECT c_custkey::VARCHAR AS path, text AS content FROM customer LEFT JOIN documents ON doc_id = c_custkey")
def _(spark, sf):
    asked = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("path"))
    held = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return sources.content_at(asked, held)


@query(
    "s5_revisions",
    "SELECT o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '^' ELSE '' END AS rev, CASE WHEN c_custkey IS NULL THEN NULL WHEN o_orderkey % 2 = 0 THEN CASE WHEN c_custkey > 1 THEN (c_custkey - 1)::VARCHAR END ELSE c_custkey::VARCHAR END AS sha, "
    "CASE WHEN c_custkey IS NULL THEN 'no commit' WHEN o_orderkey % 2 = 0 AND NOT c_custkey > 1 THEN 'no parent' END AS problem FROM orders LEFT JOIN customer ON c_custkey = o_orderkey",
)
def _(spark, sf):
    rev = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "^").otherwise(""))
    key = F.col("c_custkey")
    commits = table(spark, sf, "customer").select(key.cast("string").alias("sha"), F.when(key > 1, (key - 1).cast("string")).alias("parent"))
    return index.resolve_revisions(table(spark, sf, "orders").select(rev.alias("rev")), commits)


@query("s8_parse_grep", "SELECT 'src/' || source || '.md' AS path, n_chars::INT AS number, string_split(text, chr(10))[1] AS line FROM documents WHERE lang <> 'fr'")
def _(spark, sf):
    d = table(spark, sf, "documents")
    place = F.when(F.col("lang") == "fr", "no number").otherwise(F.col("n_chars").cast("string"))
    return lines.parse_grep(d.select(F.concat_ws(":", F.lit("HEAD"), F.concat(F.lit("src/"), "source", F.lit(".md")), place, F.split("text", "\n")[0]).alias("value")))


@query("s10_change_type", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'renamed' WHEN p_size % 3 = 0 THEN 'added' WHEN p_size % 5 = 0 THEN 'deleted' ELSE 'modified' END AS change_type FROM part")
def _(spark, sf):
    n = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", T.change_type(n % 4 == 0, n % 3 == 0, n % 5 == 0).alias("change_type"))


@query("s12_eval_cases", "SELECT 'set ' || item_id AS dataset, 'case ' || item_id AS name, 'bug' AS category, length(text) AS patch_chars, CASE WHEN item_id % 2 = 0 THEN string_split(text, ' ')[1] || ',' || string_split(text, ' ')[2] ELSE '' END AS keywords FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    words = F.split("text", " ")
    expected = F.struct(F.lit("bug").alias("category"), F.when(F.col("item_id") % 2 == 0, F.slice(words, 1, 2)).alias("keywords"))
    case = F.struct(F.concat(F.lit("case "), F.col("item_id").cast("string")).alias("name"), F.col("text").alias("patch"), expected.alias("expected"))
    written = b.select(F.to_json(F.struct(F.concat(F.lit("set "), F.col("item_id").cast("string")).alias("name"), F.array(case).alias("cases"))).alias("value"))
    cases = sources.cases_of(written.select(F.from_json("value", sources.EVAL_SCHEMA).alias("s")).select("s.*"))
    return cases.select("dataset", "name", "category", F.length("patch").cast("long").alias("patch_chars"), F.array_join("keywords", ",").alias("keywords"))


@query("s15_s26_point_lookup", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = 7 AND o_orderstatus IS NOT NULL")
def _(spark, sf):
    return filters.point_lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), o_orderkey=7)


@query("s23_markdown", f"WITH {B.FINDINGS} SELECT '- **' || upper(severity) || '** `' || file_path || ':' || run_id || '` ' || category AS value FROM findings")
def _(spark, sf):
    f = B.findings(spark, sf).withColumn("line_start", F.col("run_id")).withColumn("title", F.col("category"))
    return sources.as_markdown(f)


@query("s23_json", f"WITH {B.FINDINGS} SELECT '{{\"finding_id\":' || finding_id || ',\"severity\":\"' || severity || '\",\"file_path\":\"' || file_path || '\"}}' AS value FROM findings")
def _(spark, sf):
    return sources.as_json(B.findings(spark, sf).select("finding_id", "severity", "file_path"))


@query(
    "s24_s32_cached",
    "WITH f AS (SELECT o_custkey AS key, max(o_orderdate) AS payload FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 700 DAYS GROUP BY 1) SELECT c_custkey AS key, payload, payload IS NOT NULL AS hit FROM customer LEFT JOIN f ON key = c_custkey",
)
def _(spark, sf):
    cache = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("payload"), F.col("o_orderdate").alias("stored_at"))
    return sources.cached(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), cache, F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"), 700)


# --- predicates --------------------------------------------------------------


@query("p2_languages", f"WITH {B.FILES} SELECT file_id, language FROM files WHERE language IN ('de', 'es')")
def _(spark, sf):
    return filters.of_languages(B.files(spark, sf), ("de", "es")).select("file_id", "language")


@query("p6_ignoring_case", "SELECT doc_id FROM documents WHERE contains(lower(text), 'apache')")
def _(spark, sf):
    return table(spark, sf, "documents").filter(filters.contains_ignoring_case(F.col("text"), "APACHE")).select("doc_id")


@query("p11_reviewable", "SELECT doc_id::VARCHAR AS path FROM documents WHERE lang <> 'fr' AND n_chars >= 50 AND octet_length(encode(text)) <= 524288 AND length(text) - length(replace(text, chr(10), '')) + 1 <= 5000")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string"))
    files = d.select("path", F.when(F.col("lang") == "fr", "deleted").otherwise("modified").alias("change_type"))
    return lines.reviewable(files, d.filter("n_chars >= 50").select("path", F.col("text").alias("patch_text"))).select("path")


@query(
    "p15_literal",
    r"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[^\p{L}\p{N}\p{M}_/.\-]+'), lambda x: regexp_replace(regexp_replace(translate(x, '''"\', ''), '^[()\[\]{},;:!?<>=+*&|~`@#$%^ .\-]+', ''), '[()\[\]{},;:!?<>=+*&|~`@#$%^ .\-]+$', '')), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS terms FROM conversations)
SELECT conv_id, turn, len(list_filter(terms, lambda x: regexp_matches(x, '[_/.]|\p{Nd}') OR (x <> lower(x) AND x <> upper(x)))) > 0 AS literal FROM t""",
)
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_literal_query(F.coalesce("text", F.lit(""))).alias("literal"))


@query("p16_definition_line", "SELECT p_partkey, p_size % 4 <> 2 AS definition FROM part")
def _(spark, sf):
    n = F.col("p_size") % 4
    head = F.when(n == 0, "def ").when(n == 1, "   async def ").when(n == 2, "return ").otherwise("\tclass ")
    return table(spark, sf, "part").select("p_partkey", T.is_definition_line(F.concat(head, "p_name")).alias("definition"))


@query("p20_states", f"WITH {B.SNAPSHOTS} SELECT snapshot_id, status FROM snapshots WHERE status IN ('failed', 'cancelled')")
def _(spark, sf):
    return filters.in_states(B.snapshots(spark, sf), K.RESTARTABLE_RUN).select("snapshot_id", "status")


@query("p23_usable", "SELECT o_orderkey AS snapshot_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(spark, sf):
    s = B.snapshots(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderpriority").alias("commit_sha")), "snapshot_id")
    return filters.usable_snapshots(s, "1-URGENT").select("snapshot_id")


@query("p26_clean_answer", "SELECT conv_id, turn, trim(text || CASE WHEN turn % 2 = 0 THEN ' ' ELSE '' END, ' ') AS answer FROM conversations")
def _(spark, sf):
    call = F.when(F.col("turn") % 4 == 0, ' <|tool_call|>{"a": 1}\nrest').when(F.col("turn") % 2 == 0, " <TOOL_CALL>x").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.clean_answer(F.concat("text", call)).alias("answer"))


@query("p27_hunk_range", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size END AS first, CASE WHEN p_size % 3 > 0 THEN p_size + p_size % 3 - 1 END AS last FROM part")
def _(spark, sf):
    r = T.hunk_range(F.col("p_size"), F.col("p_size") % 3)
    return table(spark, sf, "part").select("p_partkey", r["first"].alias("first"), r["last"].alias("last"))


@query("p28_known_or", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'other' END AS segment FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.known_or(F.col("c_mktsegment"), ("BUILDING", "MACHINERY"), "other").alias("segment"))


# --- joins of lines ----------------------------------------------------------


@query("p8_j15_contained", "SELECT p.p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM part r WHERE r.p_brand = p.p_brand AND p.p_size BETWEEN r.p_size * 2 AND r.p_size * 2 + 1)")
def _(spark, sf):
    p = table(spark, sf, "part")
    points = p.select(F.col("p_brand").alias("file_id"), "p_partkey", F.col("p_size").alias("at"))
    ranges = p.select(F.col("p_brand").alias("file_id"), (F.col("p_size") * 2).alias("r_start"), (F.col("p_size") * 2 + 1).alias("r_end"))
    return lines.contained(points, ranges, "file_id").select("p_partkey")


@query("j6_ready_files", f"WITH {B.FILES} SELECT file_id, path FROM files JOIN orders ON o_orderkey = file_id WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return digests.ready_files(B.files(spark, sf).withColumn("last_seen_snapshot_id", F.col("file_id")), B.snapshots(spark, sf)).select("file_id", "path")


@query("j17_chunk_symbols", f"WITH {B.SYMBOLS} SELECT p_partkey AS chunk_id, max(symbol_id) AS exact_symbol_id FROM part LEFT JOIN symbols ON file_id = p_brand AND start_line = p_size + p_partkey % 2 AND end_line = p_size + 20 GROUP BY 1")
def _(spark, sf):
    chunks = table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("file_id"), (F.col("p_size") + F.col("p_partkey") % 2).alias("start_line"), (F.col("p_size") + 20).alias("end_line"))
    return index.chunk_symbols(chunks, B.symbols(spark, sf)).select("chunk_id", "exact_symbol_id")


@query("j21_in_classes", f"WITH {B.SYMBOLS} SELECT symbol_id FROM symbols WHERE symbol_id % 100 IN (SELECT symbol_id FROM symbols WHERE kind = 'class')")
def _(spark, sf):
    return index.in_classes(B.symbols(spark, sf).withColumn("parent_symbol_id", F.col("symbol_id") % 100)).select("symbol_id")


@query("j24_edges_of", f"WITH {B.EDGES} SELECT edge_id, source_symbol_id FROM edges WHERE target_symbol_id = 7")
def _(spark, sf):
    return filters.edges_of(B.edges(spark, sf), 7, incoming=True).select("edge_id", "source_symbol_id")


@query("a3_project_totals", f"WITH {B.FILES} SELECT (SELECT count(*) FROM files WHERE NOT is_deleted) AS files, (SELECT count(*) FROM part) AS symbols")
def _(spark, sf):
    return digests.project_totals(B.files(spark, sf), B.symbols(spark, sf))


@query("a6_edge_kinds_of_one", f"WITH {B.EDGES} SELECT kind, count(*) AS n FROM edges WHERE target_symbol_id = 9 AND source_symbol_id <> 9 GROUP BY kind")
def _(spark, sf):
    return graph.edge_kinds(B.edges(spark, sf), spark.range(9, 10).withColumnRenamed("id", "symbol_id"))


@query("a17_usage", "SELECT sum(l_linenumber)::BIGINT AS tokens_input, sum(l_partkey)::BIGINT AS tokens_output, sum((l_discount * 100)::INT)::BIGINT AS cost_usd FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return digests.usage(li.select(F.col("l_linenumber").alias("tokens_input"), F.col("l_partkey").alias("tokens_output"), F.round(F.col("l_discount") * 100).cast("int").alias("cost_usd")))


@query("a20_symbol_text", "SELECT l_orderkey AS symbol_id, string_agg(l_partkey::VARCHAR, chr(10) ORDER BY l_linenumber, l_partkey::VARCHAR) AS text FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return lines.symbol_text(li.select(F.col("l_orderkey").alias("symbol_id"), F.col("l_linenumber").alias("start_line"), F.col("l_partkey").cast("string").alias("content")))


@query("a23_extensions", "WITH e AS (SELECT p_partkey, lower(regexp_extract(regexp_replace(p_type, '^.* ', '') || CASE WHEN p_size % 7 = 0 THEN '' ELSE '.' || p_brand END, '^.+\\.([^.]+)$', 1)) AS value FROM part) SELECT value, count(*) AS n FROM e WHERE value <> '' GROUP BY 1 ORDER BY n DESC, min(p_partkey), value LIMIT 12")
def _(spark, sf):
    name = F.concat(F.regexp_replace("p_type", "^.* ", ""), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("."), "p_brand")))
    return digests.extensions(table(spark, sf, "part").select(name.alias("path"), "p_partkey"), "p_partkey")


@query("a27_hunk_bounds", "SELECT p_brand AS path, coalesce(min(p_size) FILTER (p_size % 5 > 0), 1)::INT AS first_line, coalesce(max(p_size + p_size % 5 - 1) FILTER (p_size % 5 > 0), 1)::INT AS last_line FROM part GROUP BY 1")
def _(spark, sf):
    return lines.hunk_bounds(table(spark, sf, "part").select(F.col("p_brand").alias("path"), F.col("p_size").alias("new_start"), (F.col("p_size") % 5).alias("new_lines")))


@query("a29_discarded", "SELECT l_orderkey AS run_id, sum(l_linenumber + l_suppkey + 1 + l_partkey)::BIGINT AS discarded FROM lineitem GROUP BY 1")
def _(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sum("l_linenumber").alias("outside_diff"), F.sum("l_suppkey").alias("without_evidence"), F.count("*").alias("unproven"), F.sum("l_partkey").alias("duplicate"))
    return review.discarded_total(counts).select("run_id", "discarded")


@query("a30_diff_totals", "SELECT sum(l_linenumber)::BIGINT AS added, sum(l_suppkey)::BIGINT AS removed, count(*) = 0 AS is_empty FROM lineitem")
def _(spark, sf):
    return lines.diff_totals(table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("added_lines"), F.col("l_suppkey").alias("removed_lines")))


@query("w4_w6_first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def _(spark, sf):
    return windows.first_per_key(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"), n=5).select("o_custkey", "o_orderkey")


@query("t17_queue", f"WITH {B.SNAPSHOTS} SELECT snapshot_id, status FROM snapshots ORDER BY status = 'running' DESC, snapshot_id LIMIT 60")
def _(spark, sf):
    return B.snapshots(spark, sf).orderBy(*windows.queue_order(F.col("status") == "running", F.col("snapshot_id"))).limit(60).select("snapshot_id", "status")


# --- steps -------------------------------------------------------------------


@query("x3_channel", "SELECT event_id AS cursor, event_type AS kind FROM events WHERE user_id = 7")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("cursor"), F.col("event_type").alias("kind"))
    return steps.replayed(e.filter("cursor < 6000"), e.filter("cursor > 4000"), 7).select("cursor", "kind")


@query("x4_envelope", "SELECT '{\"event\":\"step\",\"data\":{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}}' AS value FROM events")
def _(spark, sf):
    return steps.envelope(table(spark, sf, "events").select("event_id", "event_type"), "step")
