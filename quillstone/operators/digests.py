"""Counts and ratios over an index, its feedback and its evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import constants as K
from quillstone.functions import text as T
from quillstone.operators.filters import live


def files_by_language(files: DataFrame) -> DataFrame:
    """[A1]"""
    return live(files).groupBy("language").agg(F.count("*").alias("files")).select(F.coalesce("language", F.lit(K.NO_LANGUAGE)).alias("language"), "files")


def files_by_directory(files: DataFrame, k: int = 12) -> DataFrame:
    """Top-level directories; a file at the root counts by its own name. [A2]"""
    counted = live(files).groupBy(F.substring_index("path", "/", 1).alias("directory")).agg(F.count("*").alias("files"))
    return counted.orderBy(F.desc("files"), "directory").limit(k)


def index_totals(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files, symbols and chunks of live files, as one row. [A4]"""
    alive = live(files).select("file_id")
    one = lambda df, name: df.join(alive, "file_id", "left_semi").agg(F.count("*").alias(name))
    totals = alive.agg(F.count("*").alias("files"))
    # Three rows of one aggregate each.
    return totals.crossJoin(one(symbols, "symbols")).crossJoin(one(chunks, "chunks"))


def project_totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Live files over all languages, and all symbols, those of deleted files too. [A3]"""
    return files_by_language(files).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files")).join(F.broadcast(symbols.agg(F.count("*").alias("symbols"))))


def most_common(rows: DataFrame, value: Column, seen: str, k: int = 12) -> DataFrame:
    """(value, n): the k most frequent values; of equals the one seen first. Null and empty values are left out. [A23]"""
    counted = rows.select(value.alias("value"), F.col(seen).alias("_seen")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n"), F.min("_seen").alias("_first"))
    return counted.orderBy(F.desc("n"), "_first", "value").limit(k).select("value", "n")


def extensions(paths: DataFrame, seen: str, k: int = 12) -> DataFrame:
    """Extensions of a tree by frequency. [A23]"""
    return most_common(paths, T.suffix(F.col("path")), seen, k)


def vector_coverage(chunks: DataFrame, files: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks that deserve a vector, and those that have one of the model; deleted files count too. [A7, J8]"""
    asked = chunks.join(files.filter(T.deserves_vector(F.col("path"))).select("file_id"), "file_id", "left_semi")
    have = embeddings.filter(F.col("embedding_model_id") == model).select("chunk_id", F.lit(1).alias("_have")).distinct()
    return asked.join(have, "chunk_id", "left").agg(F.count("*").alias("total"), F.count("_have").alias("embedded"))


def missing_chunks(chunks: DataFrame, files: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Live chunks that deserve a vector and have none of the model. [I16, J9]"""
    asked = chunks.join(live(files).filter(T.deserves_vector(F.col("path"))).select("file_id"), "file_id", "left_semi")
    return asked.join(embeddings.filter(F.col("embedding_model_id") == model).select("chunk_id"), "chunk_id", "left_anti")


def reused_vectors(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """(chunk_id, embedding): vectors of equal content for chunks that have none. [I17, A11, J11]"""
    own = embeddings.filter(F.col("embedding_model_id") == model)
    one = chunks.join(own, "chunk_id").groupBy("content_hash").agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    return chunks.join(own.select("chunk_id"), "chunk_id", "left_anti").join(one, "content_hash").select("chunk_id", "embedding")


def check_dimensions(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows with a vector of the wrong size; none is well. [I18]"""
    return vectors.filter(F.col(column).isNull() | (F.size(column) != dim))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The newest verdict of each finding. [A10]"""
    return feedback.groupBy("finding_id").agg(F.max_by("verdict", F.struct("created_at", "feedback_id")).alias("verdict"), F.max("created_at").alias("marked_at"))


def feedback_digest(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Verdicts by kind, marked and all findings, and the useful share. [A13, J7]"""
    marked = findings.join(latest_feedback(feedback), "finding_id", "left")
    useful = F.count_if(F.col("verdict") == "useful")
    return marked.agg(
        F.count("*").alias("total_findings"), F.count("verdict").alias("marked_count"), useful.alias("useful"),
        F.count_if(F.col("verdict") == "false_positive").alias("false_positive"), F.count_if(F.col("verdict") == "wontfix").alias("wontfix"),
        F.round(F.try_divide(useful, F.count("verdict")), 6).alias("useful_share"),
    )


def status_after(verdict: Column, status: Column, has_evidence: Column) -> Column:
    """Status of a finding after its latest verdict. [D15, D22]"""
    back = F.when(has_evidence, "verified").otherwise("proposed")
    return F.when(verdict == "false_positive", "rejected").when(verdict.isNotNull() & (status == "rejected"), back).otherwise(status)


def severity_totals(findings: DataFrame, key: str = "run_id") -> DataFrame:
    """Findings by severity without rejected ones, and the rejected ones. [A12]"""
    open_ = F.col("status") != "rejected"
    return findings.groupBy(key).agg(*[F.count_if(open_ & (F.col("severity") == s)).alias(s) for s in K.SEVERITY_RANK], F.count_if(~open_).alias("rejected"))


def fails_gate(findings: DataFrame, level: str) -> DataFrame:
    """Whether the worst open finding reaches a level; without findings the worst rank is 0. [A25]"""
    worst = F.coalesce(F.max(F.when(F.col("status") != "rejected", T.severity_rank(F.col("severity")))), F.lit(0))
    return findings.agg((worst >= K.SEVERITY_RANK[level]).alias("fails"))


def ratio(part: Column, whole: Column) -> Column:
    """[A15]"""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 4)


def eval_metrics(outcomes: DataFrame) -> DataFrame:
    """outcomes(is_clean, found, severity_ok, category_ok, failed, findings, with_context) as one row of counts and ratios. [A14, A15, D17]"""
    defect = ~F.col("is_clean")
    counts = outcomes.agg(
        F.count("*").alias("cases"), F.count_if(defect).alias("defects"), F.count_if(defect & F.col("found")).alias("found"), F.count_if("is_clean").alias("clean"),
        F.count_if(F.col("is_clean") & (F.col("findings") > 0)).alias("clean_with_findings"), F.coalesce(F.sum(F.when(F.col("is_clean"), F.col("findings"))), F.lit(0)).alias("findings_on_clean"),
        F.count_if(defect & F.col("found") & F.col("severity_ok")).alias("severity_adequate"), F.count_if(defect & F.col("found") & F.col("category_ok")).alias("category_right"),
        F.count_if("failed").alias("failures"), F.count_if("with_context").alias("cases_with_context"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings_total"),
    )
    c = F.col
    return counts.select(
        "*", ratio(c("found"), c("defects")).alias("recall"), ratio(c("clean_with_findings"), c("clean")).alias("false_alarm_rate"),
        ratio(c("severity_adequate"), c("found")).alias("severity_accuracy"), ratio(c("category_right"), c("found")).alias("category_accuracy"),
    )


def repeated_recall(attempts: DataFrame) -> DataFrame:
    """[A16]"""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return attempts.agg(F.round(zero(F.avg("recall")), 6).alias("mean_recall"), zero(F.min("recall")).alias("min_recall"), zero(F.max("recall")).alias("max_recall"))


def usage(results: DataFrame) -> DataFrame:
    """[A17]"""
    return results.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_input", "tokens_output", "cost_usd")])


def unreviewed(failed: DataFrame, read: DataFrame) -> DataFrame:
    """Paths that failed and were not read, sorted. [A18, U4]"""
    return failed.select("path").distinct().join(read.select("path"), "path", "left_anti").orderBy("path")


def first_seen_order(rows: DataFrame, value: str, seq: str) -> DataFrame:
    """Distinct values in the order they came. [A19]"""
    return rows.groupBy(value).agg(F.min(seq).alias("first_seen")).orderBy("first_seen", value)


def attempt_duration(attempts: DataFrame) -> DataFrame:
    """Milliseconds over all attempts of a run. [A24]"""
    ms = F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return attempts.groupBy("run_id").agg(F.sum(ms).alias("duration_ms"), F.count("*").alias("attempts"))


def index_state(snapshots: DataFrame, coverage: DataFrame) -> DataFrame:
    """Latest snapshot of each repository with its coverage (repository_id, total, embedded). [I19, R39, T10]"""
    last = snapshots.groupBy("repository_id").agg(F.max_by(F.struct("snapshot_id", "status", "stage"), F.struct("created_at", "snapshot_id")).alias("s"))
    both = last.join(coverage, "repository_id", "left").select("repository_id", "s.*", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("embedded", F.lit(0)).alias("embedded"))
    return both.withColumn("context_ready", F.col("status") == "ready").withColumn("is_embedding", (F.col("stage") == "embedding") & (F.col("status") == "running"))


def ready_files(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files last seen by a ready snapshot. [J6]"""
    return files.join(snapshots.filter("status = 'ready'").select(F.col("snapshot_id").alias("last_seen_snapshot_id")), "last_seen_snapshot_id", "left_semi")


def past_findings(findings: DataFrame, feedback: DataFrame, path: str, k: int = 5) -> DataFrame:
    """Marked findings of a file, the latest marks first. [R41, J7]"""
    return findings.filter(F.col("file_path") == path).join(latest_feedback(feedback), "finding_id").orderBy(F.desc("marked_at"), "finding_id").limit(k)


def recent(df: DataFrame, order: str, k: int = 50, *ties: str) -> DataFrame:
    """[T12]"""
    return df.orderBy(F.desc(order), *ties).limit(k)


