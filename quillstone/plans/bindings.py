"""The driver's tables under the names of the data model, in Spark and as SQL common table expressions.

Attributes that those tables lack are derived from others of the same row; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import table


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("repository_id"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.col("lang").alias("language"), F.col("text").alias("content"), (F.col("n_chars") < 200).alias("is_deleted"), "n_chars",
    )


FILES = "files AS (SELECT doc_id AS file_id, source AS repository_id, source || '/' || lang || '/' || doc_id || '.md' AS path, lang AS language, text AS content, n_chars < 200 AS is_deleted, n_chars FROM documents)"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.col("text").alias("content"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, doc_id AS file_id, text AS content, sha256(text) AS content_hash FROM documents)"


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("main").alias("embedding_model_id"), "embedding", "label")


EMBEDDINGS = "vectors AS (SELECT vec_id AS chunk_id, 'main' AS embedding_model_id, embedding, label FROM embeddings)"


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file_id"), F.when(size <= 10, "module").when(size <= 30, "class").otherwise("function").alias("kind"),
        F.concat_ws(".", F.lower(F.replace("p_brand", F.lit("#"))), F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit(".")), (F.col("p_retailprice") * 10).cast("long").cast("string")).alias("qualified_name"),
        size.alias("start_line"), (size + 20).alias("end_line"),
    )


SYMBOLS = """symbols AS (SELECT p_partkey AS symbol_id, p_brand AS file_id, CASE WHEN p_size <= 10 THEN 'module' WHEN p_size <= 30 THEN 'class' ELSE 'function' END AS kind,
  lower(replace(p_brand, '#', '')) || '.' || lower(p_type) || '.' || replace(p_name, ' ', '.') || '.' || trunc(p_retailprice * 10)::BIGINT AS qualified_name, p_size AS start_line, p_size + 20 AS end_line FROM part)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount")
    target = symbols(spark, sf).select(F.col("symbol_id").alias("l_suppkey"), F.col("qualified_name").alias("target_qualified_name"))
    return li.join(target, "l_suppkey", "left").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_id"), F.col("l_partkey").alias("source_symbol_id"),
        F.when(F.col("l_linestatus") == "F", F.col("l_suppkey")).alias("target_symbol_id"), "target_qualified_name",
        F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "imports").otherwise("inherits").alias("kind"),
        (F.col("l_linestatus") == "F").alias("is_resolved"), F.round(1 - F.col("l_discount"), 4).alias("confidence"),
    )


EDGES = SYMBOLS + """,
edges AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edge_id, l_partkey AS source_symbol_id, CASE WHEN l_linestatus = 'F' THEN l_suppkey END AS target_symbol_id,
  s.qualified_name AS target_qualified_name, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'inherits' END AS kind, l_linestatus = 'F' AS is_resolved, round(1 - l_discount, 4) AS confidence
  FROM lineitem LEFT JOIN symbols s ON s.symbol_id = l_suppkey)"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.col("o_orderkey").alias("finding_id"), F.col("o_custkey").alias("run_id"), F.concat(F.lit("src/file_"), (F.col("o_custkey")).cast("string"), F.lit(".py")).alias("file_path"),
        F.when(p == "1", "critical").when(p == "2", "major").when(p == "3", "minor").otherwise("nitpick").alias("severity"), F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "O", "proposed").otherwise("verified").alias("status"), F.col("o_totalprice").alias("price"),
    )


FINDINGS = """findings AS (SELECT o_orderkey AS finding_id, o_custkey AS run_id, 'src/file_' || o_custkey || '.py' AS file_path,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'major' WHEN '3' THEN 'minor' ELSE 'nitpick' END AS severity, o_orderpriority AS category,
  CASE o_orderstatus WHEN 'F' THEN 'rejected' WHEN 'O' THEN 'proposed' ELSE 'verified' END AS status, o_totalprice AS price FROM orders)"""


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("feedback_id"), F.col("user_id").alias("finding_id"),
        F.when(kind == "error", "false_positive").when(kind == "view", "wontfix").otherwise("useful").alias("verdict"), F.col("ts").alias("created_at"),
    )


FEEDBACK = "feedback AS (SELECT event_id AS feedback_id, user_id AS finding_id, CASE event_type WHEN 'error' THEN 'false_positive' WHEN 'view' THEN 'wontfix' ELSE 'useful' END AS verdict, ts AS created_at FROM events)"


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    s = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("repository_id"), F.when(s == "F", "ready").when(s == "O", "running").otherwise("failed").alias("status"),
        F.when(s == "O", "embedding").otherwise("complete").alias("stage"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("finished_at"),
    )


SNAPSHOTS = """snapshots AS (SELECT o_orderkey AS snapshot_id, o_custkey AS repository_id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CASE o_orderstatus WHEN 'O' THEN 'embedding' ELSE 'complete' END AS stage, o_orderdate AS created_at, o_orderdate AS finished_at FROM orders)"""
