"""Queries of column functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import filters
from quillstone.plans import bindings as B
from quillstone.plans.registry import query
from quillstone.session import table


@query("i10_hash_and_tokens", "SELECT doc_id, sha256(text) AS content_hash, greatest(1, round_even(length(text) / 3.0, 0)::INT) AS tokens FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), T.token_estimate(F.col("text")).alias("tokens"))


@query(
    "r1_search_text",
    r"""WITH n AS (SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) || 'Of' || list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') || '_' || lower(replace(p_brand, '#', '')) AS name FROM part),
w AS (SELECT p_partkey, name, list_distinct_ordered FROM (SELECT p_partkey, name, list_filter(list_transform(regexp_extract_all(replace(name, '_', ' '), '[A-Z]+(?:[a-z0-9]+)|[a-z0-9]+|[A-Z]+'), lambda x: lower(x)), lambda x: length(x) > 1 AND x <> lower(name)) AS list_distinct_ordered FROM n))
SELECT p_partkey, name || CASE WHEN len(list_distinct_ordered) > 0 THEN chr(10) || array_to_string(list_filter(list_distinct_ordered, lambda x, i: list_position(list_distinct_ordered, x) = i), ' ') ELSE '' END AS search_text FROM w""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))
    name = F.concat(
        F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring("p_type", 2, 1 << 20)), F.lit("Of"), F.array_join(F.transform(F.split("p_name", " "), cap), ""),
        F.lit("_"), F.lower(F.replace("p_brand", F.lit("#"))),
    )
    return p.select("p_partkey", T.search_text(name).alias("search_text"))


@query(
    "r4_r5_terms",
    r"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[^\p{L}\p{N}\p{M}_/.\-]+'), lambda x: regexp_replace(regexp_replace(translate(x, '''"\', ''), '^[()\[\]{},;:!?<>=+*&|~`@#$%^ .\-]+', ''), '[()\[\]{},;:!?<>=+*&|~`@#$%^ .\-]+$', '')), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS terms FROM conversations),
d AS (SELECT conv_id, turn, list_distinct(terms) AS own FROM t),
u AS (SELECT conv_id, turn, CASE WHEN len(list_filter(own, lambda x: length(x) >= 3)) > 0 THEN list_filter(own, lambda x: length(x) >= 3) ELSE own END AS used FROM d)
SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(used, lambda x: {'n': -length(x), 't': x}))[1:40], lambda x: x.t), ' ') AS terms FROM u""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(T.longest_terms(T.clean_terms(F.coalesce("text", F.lit("")))), " ").alias("terms"))


@query(
    "p13_p14_query_kind",
    r"""SELECT conv_id, turn, regexp_matches(w, '[_/.]|\p{Nd}') OR (w <> lower(w) AND w <> upper(w)) AS code_like,
  regexp_matches(text, '[а-яёА-ЯЁ]') OR (trim(text, ' ') <> '' AND len(string_split_regex(trim(text, ' '), '\s+')) > 2) AS prose
FROM (SELECT conv_id, turn, text, string_split(text, ' ')[1] AS w FROM conversations)""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("w", F.split("text", " ")[0])
    return c.select("conv_id", "turn", T.is_code_like(F.col("w")).alias("code_like"), T.is_prose(F.col("text")).alias("prose"))


@query(
    "s11_p9_p17_paths",
    """SELECT page_id, path, coalesce(map_extract_value(MAP {'md': 'markdown', 'html': 'html', 'js': 'javascript', 'py': 'python'}, sfx), NULL) AS language, sfx NOT IN ('po', 'lock') AND path NOT LIKE '%/static/vendor/%' AND NOT regexp_matches(path, '\\.min\\.(js|css)$') AS vector, sfx IN ('md', 'rst', 'txt', 'adoc') AS document
FROM (SELECT page_id, path, regexp_extract(path, '\\.([a-z]+)$', 1) AS sfx FROM (SELECT page_id, 'repo/' || regexp_extract(url, '://([^/?#]*)', 1) || CASE WHEN length(html) < 2000 THEN '/static/vendor/page.js' WHEN length(html) < 3000 THEN '/app.min.js' WHEN length(html) < 4000 THEN '/doc.md' WHEN length(html) < 5000 THEN '/yarn.lock' WHEN length(html) < 6000 THEN '/index.html' ELSE '/main.py' END AS path FROM pages))""",
)
def _(spark, sf):
    n = F.length("html")
    tail = F.when(n < 2000, "/static/vendor/page.js").when(n < 3000, "/app.min.js").when(n < 4000, "/doc.md").when(n < 5000, "/yarn.lock").when(n < 6000, "/index.html").otherwise("/main.py")
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("repo/"), F.regexp_extract("url", "://([^/?#]*)", 1), tail).alias("path"))
    path = F.col("path")
    return p.select("page_id", "path", T.language_of(path).alias("language"), T.deserves_vector(path).alias("vector"), T.is_document(path).alias("document"))


@query(
    "d5_dedup_key",
    "SELECT o_orderkey, sha256(o_orderpriority || chr(31) || chr(31) || CASE WHEN o_orderstatus = 'F' THEN 'symbol' ELSE 'file_' || o_custkey END || chr(31) || trim(regexp_replace(o_orderpriority || '   ' || o_orderstatus || chr(10), '\\s+', ' ', 'g'), ' ')) AS dedup_key FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    fragment = F.concat("o_orderpriority", F.lit("   "), "o_orderstatus", F.lit("\n"))
    symbol = F.when(F.col("o_orderstatus") == "F", "symbol")
    key = T.dedup_key(F.col("o_orderpriority"), F.lit(None).cast("string"), symbol, F.concat(F.lit("file_"), F.col("o_custkey").cast("string")), fragment)
    return o.select("o_orderkey", key.alias("dedup_key"))


@query("p12_size_and_s6_subject", "SELECT doc_id, octet_length(encode(text))::INT AS bytes, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS lines, CASE WHEN trim(string_split(text, chr(10))[1], ' ') <> '' THEN trim(string_split(text, chr(10))[1], ' ') END AS subject FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return d.select("doc_id", F.octet_length("text").alias("bytes"), lines.alias("lines"), T.commit_subject(F.col("text")).alias("subject"))


@query("p3_path_match", f"WITH {B.FILES} SELECT file_id, path FROM files WHERE path LIKE 'src1%/en/%' AND NOT is_deleted")
def _(spark, sf):
    return filters.live(B.files(spark, sf)).filter(filters.path_matches(F.col("path"), "/src1*/en/*")).select("file_id", "path")


@query("p10_p24_globs", f"WITH {B.FILES} SELECT file_id, regexp_full_match(path, 'src[0-4]/.*\\.md') AS included, path LIKE '%fr/1%' AS git FROM files")
def _(spark, sf):
    path = F.col("path")
    return B.files(spark, sf).select("file_id", path.rlike(filters.glob_regex("src[0-4]/*.md")).alias("included"), filters.git_path_matches(path, "fr/1").alias("git"))


@query("p5_t7_find_by_name", f"WITH {B.SYMBOLS} SELECT symbol_id, qualified_name FROM symbols WHERE qualified_name = '9000' OR qualified_name LIKE '%.9000' OR qualified_name LIKE '%.900_' ORDER BY qualified_name, symbol_id LIMIT 10")
def _(spark, sf):
    from quillstone.operators.windows import name_order

    s = B.symbols(spark, sf)
    q = F.col("qualified_name")
    found = s.filter(filters.name_matches(q, "9000") | filters.name_matches(q, "900_"))
    return found.orderBy(*name_order("9000", q), "symbol_id").limit(10).select("symbol_id", "qualified_name")


@query("p7_r13_covering", f"WITH {B.SYMBOLS} SELECT symbol_id, file_id, start_line, end_line FROM symbols WHERE start_line <= 30 AND end_line >= 25")
def _(spark, sf):
    s = B.symbols(spark, sf)
    return s.filter(filters.overlaps(F.col("start_line"), F.col("end_line"), F.lit(25), F.lit(30))).select("symbol_id", "file_id", "start_line", "end_line")


@query("p21_tenant_scope", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderkey = l_orderkey)")
def _(spark, sf):
    t = lambda n: table(spark, sf, n)
    chain = [(t("nation"), "n_regionkey", "r_regionkey"), (t("customer"), "c_nationkey", "n_nationkey"), (t("orders"), "o_custkey", "c_custkey"), (t("lineitem"), "l_orderkey", "o_orderkey")]
    return filters.scoped_to_tenant(t("region"), "ASIA", *chain, column="r_name")[-1].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("p18_p22_markers", "SELECT doc_id, contains(lower(text), 'stupid') OR contains(lower(text), 'caller') OR contains(lower(text), 'соседн') AS marked FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.holds_any(F.col("text"), ("stupid", "caller", "соседн")).alias("marked"))


@query(
    "p19_severity_rank",
    f"WITH {B.FINDINGS} SELECT finding_id, CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 WHEN 'minor' THEN 1 ELSE 0 END AS rank, CASE category WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE -1 END AS level FROM findings",
)
def _(spark, sf):
    f = B.findings(spark, sf)
    return f.select("finding_id", T.severity_rank(F.col("severity")).alias("rank"), T.level_rank(F.col("category"), ("1-URGENT", "2-HIGH")).alias("level"))


@query("d15_status", f"WITH {B.FEEDBACK}, {B.FINDINGS}, l AS (SELECT finding_id, arg_max(verdict, (created_at, feedback_id)) AS verdict FROM feedback GROUP BY 1) SELECT f.finding_id, CASE WHEN verdict = 'false_positive' THEN 'rejected' WHEN verdict IS NOT NULL AND status = 'rejected' THEN CASE WHEN price > 100000 THEN 'verified' ELSE 'proposed' END ELSE status END AS status FROM findings f LEFT JOIN l USING (finding_id)")
def _(spark, sf):
    from quillstone.operators.digests import latest_feedback, status_after

    both = B.findings(spark, sf).join(latest_feedback(B.feedback(spark, sf)), "finding_id", "left")
    return both.select("finding_id", status_after(F.col("verdict"), F.col("status"), F.col("price") > 100000).alias("status"))


