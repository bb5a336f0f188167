"""File trees, data sets, logs and caches as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T

EVAL_SCHEMA = (
    "name string, description string, cases array<struct<name:string, file_path:string, patch:string, tags:array<string>, "
    "expected:struct<category:string, min_severity:string, keywords:array<string>>>>"
)
LEVELS = ("debug", "info", "warning", "error", "critical")
LOG_FIELDS = ("timestamp", "level", "logger", "event", "exception")
MOST_LINES = 1000


def tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, content_hash, language): the text files under a folder. [S1, S2, S11]"""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    rows = read.select(F.expr(f"substring(regexp_replace(_metadata.file_path, '^[a-z]+:/*', '/'), {len(root.rstrip('/')) + 2})").alias("path"), F.col("value").alias("content"))
    return rows.select("path", "content", T.content_hash(F.col("content")).alias("content_hash"), T.language_of(F.col("path")).alias("language"))


def listing(rows: DataFrame) -> DataFrame:
    """(mode, path, blob) listing without links and submodules. [S1]"""
    return rows.filter(F.col("mode").isin("100644", "100755")).select("path", F.col("blob").alias("content_hash"))


def content_at(paths: DataFrame, contents: DataFrame) -> DataFrame:
    """Contents of asked paths, null where there is none. [S2, S16]"""
    return paths.join(contents, "path", "left")


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of JSON data sets. [S12]"""
    return cases_of(spark.read.schema(EVAL_SCHEMA).json(path, multiLine=True))


def cases_of(sets: DataFrame) -> DataFrame:
    """Cases of data sets as rows; a case without keywords is a clean one. [S12]"""
    return sets.select(F.col("name").alias("dataset"), F.explode("cases").alias("c")).select("dataset", "c.name", "c.file_path", "c.patch", "c.tags", "c.expected.category", "c.expected.min_severity", F.coalesce("c.expected.keywords", F.array().cast("array<string>")).alias("keywords"))


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Five known fields and the rest of each JSON line; other lines have a null event map. [S31]"""
    fields = F.from_json(F.col(column), "map<string,string>")
    rest = F.map_filter("_m", lambda k, _: ~k.isin(*LOG_FIELDS))
    parsed = lines.withColumn("_m", F.when(F.trim(column).startswith("{"), fields))
    return parsed.select(*lines.columns, *[F.try_element_at("_m", F.lit(f)).alias(f) for f in LOG_FIELDS], rest.alias("fields"), F.col("_m").isNotNull().alias("parsed"))


def log_tail(lines: DataFrame, k: int, min_level: str | None = None, logger: str = "", words: str = "", number: str = "number") -> DataFrame:
    """The last k matching lines in order. lines(number, value). [S13, P19]"""
    rows = parse_log(lines).filter("parsed")
    if min_level:
        rows = rows.filter(T.level_rank(F.lower("level"), LEVELS) >= LEVELS.index(min_level))
    if logger:
        rows = rows.filter(F.col("logger").startswith(logger))
    if words:
        rows = rows.filter(F.contains(F.lower("value"), F.lit(words.lower())))
    return rows.orderBy(F.desc(number)).limit(min(k, MOST_LINES)).orderBy(number)


def cache_key(*parts: Column) -> Column:
    """Key of a request: sha256 of its canonical JSON. [S24]"""
    return F.sha2(F.to_json(F.struct(*parts)).cast("binary"), 256)


def cached(requests: DataFrame, cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Requests (key) with a stored payload that is not too old, and whether there was one. [S24, S32]"""
    fresh = cache.filter(F.col("stored_at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    last = fresh.groupBy("key").agg(F.max_by("payload", "stored_at").alias("payload"))
    return requests.join(last, "key", "left").withColumn("hit", F.col("payload").isNotNull())


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    """[S17]"""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row. [S23, X4]"""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def as_markdown(findings: DataFrame) -> DataFrame:
    """A finding as a Markdown item. [S23]"""
    return findings.select(F.format_string("- **%s** `%s:%d` %s", F.upper("severity"), F.col("file_path"), F.col("line_start"), F.col("title")).alias("value"))
