"""Queries of digests, coverage, feedback, evaluations and step streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import digests, index, review, windows
from quillstone.plans import bindings as B
from quillstone.plans.registry import query
from quillstone.session import table
from quillstone.streaming import steps


@query("a1_files_by_language", f"WITH {B.FILES} SELECT coalesce(language, 'прочее') AS language, count(*) AS files FROM files WHERE NOT is_deleted GROUP BY 1")
def _(spark, sf):
    return digests.files_by_language(B.files(spark, sf))


@query("a2_files_by_directory", f"WITH {B.FILES} SELECT split_part(path, '/', 1) AS directory, count(*) AS files FROM files WHERE NOT is_deleted GROUP BY 1 ORDER BY files DESC, directory LIMIT 12")
def _(spark, sf):
    return digests.files_by_directory(B.files(spark, sf))


@query("a4_index_totals", f"WITH {B.FILES}, {B.CHUNKS} SELECT (SELECT count(*) FROM files WHERE NOT is_deleted) AS files, (SELECT count(*) FROM labels WHERE doc_id IN (SELECT file_id FROM files WHERE NOT is_deleted)) AS symbols, (SELECT count(*) FROM chunks WHERE file_id IN (SELECT file_id FROM files WHERE NOT is_deleted)) AS chunks")
def _(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "file_id")
    return digests.index_totals(B.files(spark, sf), labels, B.chunks(spark, sf))


@query("a7_coverage", f"WITH {B.CHUNKS}, {B.EMBEDDINGS} SELECT count(*) AS total, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM vectors)) AS embedded FROM chunks")
def _(spark, sf):
    return digests.vector_coverage(B.chunks(spark, sf), B.files(spark, sf), B.embeddings(spark, sf), "main")


@query("i16_missing_chunks", f"WITH {B.FILES}, {B.CHUNKS}, {B.EMBEDDINGS} SELECT chunk_id FROM chunks WHERE file_id IN (SELECT file_id FROM files WHERE NOT is_deleted) AND chunk_id NOT IN (SELECT chunk_id FROM vectors)")
def _(spark, sf):
    return digests.missing_chunks(B.chunks(spark, sf), B.files(spark, sf), B.embeddings(spark, sf), "main").select("chunk_id")


@query("i17_reused_vectors", f"WITH {B.CHUNKS}, {B.EMBEDDINGS}, one AS (SELECT content_hash, arg_min(embedding, chunk_id) AS e FROM chunks JOIN vectors USING (chunk_id) GROUP BY 1) SELECT chunk_id, round(e[1]::DOUBLE, 6) AS first_value FROM chunks JOIN one USING (content_hash) WHERE chunk_id NOT IN (SELECT chunk_id FROM vectors)")
def _(spark, sf):
    reused = digests.reused_vectors(B.chunks(spark, sf), B.embeddings(spark, sf), "main")
    return reused.select("chunk_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@query("i18_dimensions", "SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 7 = 0")
def _(spark, sf):
    """Of vectors that are cut, or lost, by their ids."""
    key = F.col("chunk_id")
    vectors = B.embeddings(spark, sf).withColumn("embedding", F.when(key % 3 == 0, F.slice("embedding", 1, 63)).when(key % 7 != 0, F.col("embedding")))
    return digests.check_dimensions(vectors, 64).select("chunk_id")


@query("a10_latest_feedback", f"WITH {B.FEEDBACK} SELECT finding_id, arg_max(verdict, (created_at, feedback_id)) AS verdict, max(created_at) AS marked_at FROM feedback GROUP BY 1")
def _(spark, sf):
    return digests.latest_feedback(B.feedback(spark, sf))


@query("a13_feedback_digest", f"WITH {B.FINDINGS}, {B.FEEDBACK}, l AS (SELECT finding_id, arg_max(verdict, (created_at, feedback_id)) AS verdict FROM feedback GROUP BY 1), m AS (SELECT verdict FROM findings LEFT JOIN l USING (finding_id)) SELECT count(*) AS total_findings, count(verdict) AS marked_count, count(*) FILTER (verdict = 'useful') AS useful, count(*) FILTER (verdict = 'false_positive') AS false_positive, count(*) FILTER (verdict = 'wontfix') AS wontfix, round(count(*) FILTER (verdict = 'useful') / nullif(count(verdict), 0), 6) AS useful_share FROM m")
def _(spark, sf):
    return digests.feedback_digest(B.findings(spark, sf), B.feedback(spark, sf))


@query("a12_severity_totals", f"WITH {B.FINDINGS} SELECT run_id, count(*) FILTER (severity = 'critical' AND status <> 'rejected') AS critical, count(*) FILTER (severity = 'major' AND status <> 'rejected') AS major, count(*) FILTER (severity = 'minor' AND status <> 'rejected') AS minor, count(*) FILTER (severity = 'nitpick' AND status <> 'rejected') AS nitpick, count(*) FILTER (status = 'rejected') AS rejected FROM findings GROUP BY run_id")
def _(spark, sf):
    return digests.severity_totals(B.findings(spark, sf))


@query("a25_gate", f"WITH {B.FINDINGS} SELECT coalesce(max(CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 WHEN 'minor' THEN 1 ELSE 0 END) FILTER (status <> 'rejected'), 0) >= 2 AS fails FROM findings")
def _(spark, sf):
    return digests.fails_gate(B.findings(spark, sf), "major")


OUTCOMES = "o AS (SELECT quality = 1 AS is_clean, toxic = 1 AS found, n_chars > 1000 AS severity_ok, lang = 'en' AS category_ok, n_chars < 100 AS failed, toxic AS findings, n_chars > 500 AS with_context FROM labels JOIN documents USING (doc_id))"


@query(
    "a14_a15_eval_metrics",
    f"""WITH {OUTCOMES}, c AS (SELECT count(*) AS cases, count(*) FILTER (NOT is_clean) AS defects, count(*) FILTER (NOT is_clean AND found) AS found, count(*) FILTER (is_clean) AS clean, count(*) FILTER (is_clean AND findings > 0) AS clean_with_findings,
  coalesce(sum(findings) FILTER (is_clean), 0)::BIGINT AS findings_on_clean, count(*) FILTER (NOT is_clean AND found AND severity_ok) AS severity_adequate, count(*) FILTER (NOT is_clean AND found AND category_ok) AS category_right,
  count(*) FILTER (failed) AS failures, count(*) FILTER (with_context) AS cases_with_context, sum(findings)::BIGINT AS findings_total FROM o)
SELECT *, round(coalesce(found / nullif(defects, 0), 0), 4) AS recall, round(coalesce(clean_with_findings / nullif(clean, 0), 0), 4) AS false_alarm_rate, round(coalesce(severity_adequate / nullif(found, 0), 0), 4) AS severity_accuracy, round(coalesce(category_right / nullif(found, 0), 0), 4) AS category_accuracy FROM c""",
)
def _(spark, sf):
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    n = F.col("n_chars")
    return digests.eval_metrics(both.select((F.col("quality") == 1).alias("is_clean"), (F.col("toxic") == 1).alias("found"), (n > 1000).alias("severity_ok"), (F.col("lang") == "en").alias("category_ok"), (n < 100).alias("failed"), F.col("toxic").alias("findings"), (n > 500).alias("with_context")))


@query("a16_repeated_recall", "SELECT round(avg(l_discount), 6) AS mean_recall, min(l_discount) AS min_recall, max(l_discount) AS max_recall FROM lineitem")
def _(spark, sf):
    return digests.repeated_recall(table(spark, sf, "lineitem").select(F.col("l_discount").alias("recall")))


@query("a18_unreviewed", "SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 25)")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "path")
    return digests.unreviewed(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag = 'A' AND l_quantity > 25"))


@query("a19_first_seen", "SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1")
def _(spark, sf):
    return digests.first_seen_order(table(spark, sf, "events"), "event_type", "event_id")


@query("a24_duration", "SELECT o_custkey AS run_id, sum(epoch_ms(l_shipdate) - epoch_ms(o_orderdate))::BIGINT AS duration_ms, count(*) AS attempts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, sf):
    both = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return digests.attempt_duration(both.select(F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.col("l_shipdate").alias("finished_at")))


@query("i19_index_state", f"WITH {B.SNAPSHOTS}, s AS (SELECT repository_id, arg_max((snapshot_id, status, stage), (created_at, snapshot_id)) AS s FROM snapshots GROUP BY 1), c AS (SELECT o_custkey AS repository_id, count(*) AS total, count(*) FILTER (o_totalprice > 100000) AS embedded FROM orders GROUP BY 1) SELECT repository_id, s[1] AS snapshot_id, s[2] AS status, s[3] AS stage, coalesce(total, 0) AS total, coalesce(embedded, 0) AS embedded, s[2] = 'ready' AS context_ready, s[3] = 'embedding' AND s[2] = 'running' AS is_embedding FROM s LEFT JOIN c USING (repository_id)")
def _(spark, sf):
    o = table(spark, sf, "orders")
    coverage = o.groupBy(F.col("o_custkey").alias("repository_id")).agg(F.count("*").alias("total"), F.count_if(F.col("o_totalprice") > 100000).alias("embedded"))
    return digests.index_state(B.snapshots(spark, sf), coverage)


@query("t10_latest_ready", f"WITH {B.SNAPSHOTS} SELECT repository_id, arg_max(snapshot_id, (finished_at, snapshot_id)) AS snapshot_id FROM snapshots WHERE status = 'ready' GROUP BY 1")
def _(spark, sf):
    return index.latest_ready(B.snapshots(spark, sf))


@query("r41_past_findings", f"WITH {B.FINDINGS}, {B.FEEDBACK}, l AS (SELECT finding_id, arg_max(verdict, (created_at, feedback_id)) AS verdict, max(created_at) AS marked_at FROM feedback GROUP BY 1) SELECT finding_id, severity, verdict, marked_at FROM findings JOIN l USING (finding_id) WHERE file_path = 'src/file_899.py' ORDER BY marked_at DESC, finding_id LIMIT 5")
def _(spark, sf):
    return digests.past_findings(B.findings(spark, sf), B.feedback(spark, sf), "src/file_899.py").select("finding_id", "severity", "verdict", "marked_at")


@query("t12_recent", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(spark, sf):
    return digests.recent(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 50, "o_orderkey")


@query("w3_latest_per_key", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) FILTER (true) AS newest FROM events GROUP BY user_id")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    last = windows.latest_per_key(e, ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_type")
    return last.join(e.groupBy("user_id").agg(F.max("event_id").alias("newest")), "user_id")


@query("d21_restarted", f"WITH {B.SNAPSHOTS} SELECT snapshot_id, CASE WHEN status = 'failed' THEN 'queued' ELSE status END AS status, 1 + (status = 'failed')::INT AS attempt, CASE WHEN status = 'failed' THEN 0 ELSE 7 END AS duration_ms FROM snapshots")
def _(spark, sf):
    runs = B.snapshots(spark, sf).withColumn("attempt", F.lit(1))
    for c in ("duration_ms", "tokens_input", "tokens_output", "cost_usd", "files_with_context"):
        runs = runs.withColumn(c, F.lit(7))
    return review.restarted(runs).select("snapshot_id", "status", "attempt", "duration_ms")


@query("d16_route_model", "SELECT c_custkey AS request_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'remote-b' WHEN c_acctbal > 5000 THEN CASE WHEN c_nationkey > 10 THEN 'remote-a' ELSE 'local-s' END ELSE 'local-s' END AS model FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer")
    requests = c.select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_mktsegment") == "BUILDING", "remote-b").otherwise("").alias("named"), F.lit(1).alias("min_level"), (F.col("c_acctbal") > 5000).alias("deep"), (F.col("c_nationkey") > 10).alias("allow_remote"))
    return review.route_model(requests, [("local-s", True, 1), ("remote-a", False, 3), ("remote-b", False, 2)])


@query("x1_cursor", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) + 100 AS cursor FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return steps.with_cursor(e, 100, ["ts", "event_id"]).select("event_id", "cursor")


@query("x2_replayed", "SELECT DISTINCT user_id AS run_id, event_id AS cursor, event_type AS kind FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("cursor"), F.col("event_type").alias("kind"))
    return steps.replayed(e.filter("cursor < 6000"), e.filter("cursor > 4000"))


@query("x11_encode_decode", "SELECT event_id, event_type, value FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type", "value")
    return steps.decode(steps.encode(e), "event_id long, event_type string, value double")


@query("ext_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts"), "event_type")
    return steps.windowed_counts(e, "ts", "1 day", "1 hour", "event_type").select(F.col("window.start").alias("day"), "event_type", "n")
