"""Queries over stored indexes: built from the tables into the shared folder, then searched."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import deadline, name_index, search, text_index, vector_index
from quillstone.plans import bindings as B
from quillstone.plans.registry import query
from quillstone.plans.retrieval import LEX, NEAR, TERMS, VECTOR, ranked_sql
from quillstone.session import table
from quillstone.sources import log_blocks
from quillstone.sources.stored import StoredTable, cascade
from quillstone.storage import index_path, kept, shared_dir
from quillstone.streaming import tail

BATCH = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(b.e, a.e) / (b.n * a.n), 6) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 10"""


def vectors_at(spark, sf) -> vector_index.VectorIndex:
    path = index_path(spark, "vectors", sf)
    vector_index.build(B.embeddings(spark, sf), path, "chunk_id", "embedding")
    return vector_index.VectorIndex(spark, path)


@query("r10_indexed_search", NEAR)
def _(spark, sf):
    return vectors_at(spark, sf).search(VECTOR, 50, exact=True).withColumnRenamed("id", "doc_id")


@query("r10_t3_indexed_batch", BATCH)
def _(spark, sf):
    asked = B.embeddings(spark, sf).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors_at(spark, sf).search_all(asked, 10, exact=True).withColumnRenamed("id", "chunk_id").select("query_id", "chunk_id", "score", "rank")


def terms_at(spark, sf) -> str:
    path = index_path(spark, "terms", sf)
    text_index.build_terms(table(spark, sf, "documents"), path, "doc_id", "text")
    return path


def grams_at(spark, sf) -> str:
    path = index_path(spark, "grams", sf)
    text_index.build_grams(table(spark, sf, "documents"), path, "doc_id", "text")
    return path


@query("r7_r8_stored_rank", f"WITH {LEX} {ranked_sql(TERMS, 50)}")
def _(spark, sf):
    ranked = text_index.rank_terms(spark, terms_at(spark, sf), TERMS)
    return search.top(ranked, 50, F.desc("score"), F.col("id")).withColumnRenamed("id", "doc_id")


@query("p6_t2_stored_substring", "SELECT doc_id, length(text) AS n_chars FROM documents WHERE contains(lower(text), 'ache lic') ORDER BY n_chars, doc_id LIMIT 50")
def _(spark, sf):
    found = text_index.containing(spark, grams_at(spark, sf), "ACHE Lic")
    return search.top(found, 50, F.col("n_chars"), F.col("id")).withColumnRenamed("id", "doc_id")


@query("p6_stored_places", "SELECT doc_id, unnest(list_filter(range(length(text)), lambda i: lower(text)[i + 1:i + 4] = 'that'))::INT AS place FROM documents WHERE contains(lower(text), 'that')")
def _(spark, sf):
    found = text_index.substring_places(spark, grams_at(spark, sf), "that")
    return found.select(F.col("id").alias("doc_id"), F.col("at").alias("place"))


@query("r6_stored_staged", "SELECT doc_id, 2 AS stage, 0.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'ache lic') ORDER BY length(text), doc_id LIMIT 20")
def _(spark, sf):
    path = grams_at(spark, sf)
    text_index.build_terms(table(spark, sf, "documents"), path, "doc_id", "text")
    found = text_index.staged(spark, path, [["qqqq_none"], ["qqqq.none"]], "ache lic", ["apache"], 20)
    return found.withColumnRenamed("id", "doc_id")


def stored_parts(spark, sf, name: str) -> StoredTable:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    return StoredTable(spark, index_path(spark, f"table-{name}", sf)).create(p, ["p_partkey"])


def changed_parts(spark, sf):
    """Every hundredth part, renamed, and as many new ones."""
    p = table(spark, sf, "part").filter("p_partkey % 100 = 0").select("p_partkey", "p_brand", "p_name", "p_size")
    return p.withColumn("p_name", F.concat(F.lit("new "), "p_name")).unionByName(p.withColumn("p_partkey", -1 - F.col("p_partkey")))


@query(
    "s18_s20_stored_upsert",
    "WITH f AS (SELECT p_partkey, p_brand, 'new ' || p_name AS p_name, p_size FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT -1 - p_partkey, p_brand, p_name, p_size FROM part WHERE p_partkey % 100 = 0) "
    "SELECT p_partkey, p_brand, p_name, p_size FROM f UNION ALL SELECT p_partkey, p_brand, p_name, p_size FROM part WHERE p_partkey % 100 <> 0",
)
def _(spark, sf):
    t = stored_parts(spark, sf, "upsert")
    t.upsert(changed_parts(spark, sf))
    return t.read()


@query("s18_s19_stored_insert", "SELECT p_partkey, p_name FROM part UNION ALL SELECT -1 - p_partkey, p_name FROM part WHERE p_partkey % 100 = 0")
def _(spark, sf):
    t = stored_parts(spark, sf, "insert")
    t.insert_missing(changed_parts(spark, sf))
    return t.read().select("p_partkey", "p_name")


@query(
    "s21_s22_stored_cascade",
    "WITH gone AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 20 = 3)) "
    "SELECT 'orders' AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone) "
    "UNION ALL SELECT 'lines', count(*), sum(l_orderkey)::BIGINT FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone))",
)
def _(spark, sf):
    orders = StoredTable(spark, index_path(spark, "table-orders", sf)).create(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    lines_ = StoredTable(spark, index_path(spark, "table-lines", sf)).create(li, ["l_orderkey", "l_linenumber"])
    cascade(table(spark, sf, "customer").filter("c_custkey % 20 = 3").select("c_custkey"), [(orders, "o_custkey"), (lines_, "l_orderkey")])
    total = lambda t, name, key: t.read().agg(F.count("*").alias("n"), F.sum(key).alias("ids")).select(F.lit(name).alias("name"), "n", "ids")
    return total(orders, "orders", "o_orderkey").unionByName(total(lines_, "lines", "l_orderkey"))


CHANGED = """WITH s0 AS (SELECT p_partkey AS symbol_id, p_brand AS file_id, CASE WHEN p_size <= 10 THEN 'module' WHEN p_size <= 30 THEN 'class' ELSE 'function' END AS kind, p_size AS start_line,
  lower(replace(p_brand, '#', '')) || '.' || lower(p_type) || '.' || replace(p_name, ' ', '.') || '.' || trunc(p_retailprice * 10)::BIGINT AS qualified_name FROM part),
symbols AS (SELECT symbol_id, file_id, kind, start_line, CASE WHEN symbol_id % 100 = 7 THEN qualified_name || '7' ELSE qualified_name END AS qualified_name FROM s0),
e AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edge_id, CASE WHEN l_linestatus = 'F' THEN l_suppkey END AS t0, s0.qualified_name AS name, round(1 - l_discount, 4) AS c0 FROM lineitem LEFT JOIN s0 ON symbol_id = l_suppkey),
edges AS (SELECT edge_id, any_value(t0) AS t0, any_value(name) AS name, any_value(c0) AS c0 FROM e GROUP BY edge_id HAVING count(*) = 1),
f AS (SELECT qualified_name, arg_min(symbol_id, (start_line, symbol_id)) AS target FROM symbols GROUP BY 1 HAVING count(DISTINCT file_id) = 1),
g AS (SELECT regexp_replace(qualified_name, '^.*\\.', '') AS segment, min(symbol_id) AS target FROM symbols WHERE kind <> 'module' GROUP BY 1 HAVING count(*) = 1)
SELECT edge_id, coalesce(t0, f.target, g.target) AS target_symbol_id, CASE WHEN t0 IS NULL AND f.target IS NULL AND g.target IS NOT NULL THEN 0.3 ELSE c0 END AS confidence
FROM edges LEFT JOIN f ON f.qualified_name = name LEFT JOIN g ON g.segment = regexp_replace(name, '^.*\\.', '')"""


@query("i12_a8_a9_incremental", CHANGED)
def _(spark, sf):
    """Edges after a build that renamed every hundredth symbol: the renamed names are resolved again, the others stay."""
    symbols = B.symbols(spark, sf)
    edges = B.edges(spark, sf)
    once = edges.groupBy("edge_id").count().filter("count = 1").select("edge_id")
    index = name_index.NameIndex(spark, index_path(spark, "names", sf)).create(symbols, edges.join(once, "edge_id"))
    old = symbols.filter("symbol_id % 100 = 7")
    index.apply(old, old.withColumn("qualified_name", F.concat("qualified_name", F.lit("7"))))
    return index.edges().select("edge_id", "target_symbol_id", "confidence")


@query("r9_ranked_in_time", f"WITH {LEX} {ranked_sql(TERMS, 50)}")
def _(spark, sf):
    """A ranked search under a deadline; its top rows are few."""
    ranked = search.top(search.cover_rank(table(spark, sf, "documents"), "doc_id", "text", TERMS), 50, F.desc("score"), F.col("doc_id"))
    return spark.createDataFrame(deadline.within(spark, 600.0, ranked.collect), ranked.schema)


@query("x2_live_tail", "SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS number, event_type AS kind, false AS gap FROM events")
def _(spark, sf):
    """Stored steps of each run, then a stream that repeats a part of them and brings the rest out of order, and in part twice."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("number"), F.col("event_type").alias("kind"))
    at = kept(e, "steps")
    folder = f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("run_id", "number"), F.lit(3))
    for n in (2, 0, 1, 0, 2):
        at.filter((F.col("number") >= 2) & (part == n)).write.mode("append").parquet(f"{folder}/source")
    history = at.filter("number < 4")
    stream = spark.readStream.schema(at.schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/source")
    tail.follow(tail.live_tail(stream, history), f"{folder}/out", f"{folder}/check").awaitTermination()
    live = spark.read.parquet(f"{folder}/out").select(F.col("run_id").cast(at.schema["run_id"].dataType).alias("run_id"), "number", "kind", "gap")
    return history.withColumn("gap", F.lit(False)).unionByName(live)


@query("s13_s14_file_tail", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100")
def _(spark, sf):
    """Events written as a log of several files; its last errors are read from the end."""
    e = table(spark, sf, "events").orderBy("event_id")
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    line = F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), level.alias("level"), F.lit("events").alias("logger"), F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id")))
    path = index_path(spark, "log", sf)
    e.select(line.alias("value")).write.mode("overwrite").text(path)
    found = log_blocks.tail(spark, path, 100, min_level="error", block=1 << 16).rows
    return found.select(*[F.element_at("fields", c).cast("long").alias(c) for c in ("event_id", "user_id")])
