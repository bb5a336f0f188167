"""Keeping an index up to date: diffs of hash maps, upserts, deletes and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T


def tree_diff(stored: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, action): unchanged, changed, new or vanished, from two (path, content_hash) maps. [J20, J19, I1]"""
    s = stored.select("path", F.col("content_hash").alias("_old"))
    t = tree.select("path", F.col("content_hash").alias("_new"))
    action = F.when(F.col("_new").isNull(), "vanished").when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return s.join(t, "path", "full_outer").select("path", action.alias("action"))


def apply_tree(files: DataFrame, diff: DataFrame, tree: DataFrame, snapshot_id: str) -> DataFrame:
    """Files after a build: seen ones marked, vanished ones soft-deleted, new ones added. [I21, I22, S18]"""
    both = files.join(diff, "path", "full_outer").join(tree.select("path", F.col("content_hash").alias("_new")), "path", "left")
    seen = F.col("action").isin("unchanged", "changed", "new")
    return both.select(
        F.coalesce("file_id", F.sha2(F.col("path").cast("binary"), 256)).alias("file_id"), "path", F.coalesce("_new", "content_hash").alias("content_hash"),
        F.coalesce("language", T.language_of(F.col("path"))).alias("language"), F.coalesce("first_seen_snapshot_id", F.lit(snapshot_id)).alias("first_seen_snapshot_id"),
        F.when(seen, F.lit(snapshot_id)).otherwise(F.col("last_seen_snapshot_id")).alias("last_seen_snapshot_id"),
        F.when(seen, F.lit(False)).when(F.col("action") == "vanished", F.lit(True)).otherwise(F.col("is_deleted")).alias("is_deleted"),
    )


def insert_missing(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of fresh whose key it lacks. [S18, S19, S29, I15, D18]"""
    return stored.unionByName(fresh.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys))


def replace_children(stored: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in fresh replaced wholesale. [I21]"""
    return stored.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def cascade(dead: DataFrame, key: str, tables: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Tables without the children of dead rows, down a chain of (table, its parent key, its own key). [S22, S28, J10]"""
    gone, out = dead.select(F.col(key).alias("_gone")).distinct(), []
    for table, parent, own in tables:
        out.append(table.join(gone, F.col(parent) == F.col("_gone"), "left_anti"))
        gone = table.join(gone, F.col(parent) == F.col("_gone"), "left_semi").select(F.col(own).alias("_gone")).distinct()
    return out


def build_counters(diff: DataFrame) -> DataFrame:
    """[A22]"""
    of = lambda *a: F.count_if(F.col("action").isin(*a))
    return diff.agg(of("changed", "new").alias("parsed"), of("unchanged").alias("reused"), of("unchanged", "changed", "new").alias("stored"), of("vanished").alias("deleted"))


def latest_ready(snapshots: DataFrame) -> DataFrame:
    """[T10]"""
    return snapshots.filter("status = 'ready'").groupBy("repository_id").agg(F.max_by("snapshot_id", F.struct("finished_at", "snapshot_id")).alias("snapshot_id"))


def needs_build(repositories: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Repositories (repository_id, head_sha) without a ready snapshot at their head or an unfinished build. [I20]"""
    busy = snapshots.filter((F.col("status") == "ready") | F.col("status").isin("pending", "running"))
    cond = (F.col("repository_id") == F.col("_r")) & (F.col("status").isin("pending", "running") | (F.col("commit_sha") == F.col("head_sha")))
    return repositories.join(busy.withColumnRenamed("repository_id", "_r"), cond, "left_anti")


def pick_up(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """requests(repository_id, commit_sha) with the snapshot to go on with and what to do: reuse a pending one, abort a cancelled one, else create. [I23]"""
    held = snapshots.filter(F.col("status").isin("pending", "cancelled")).groupBy("repository_id", "commit_sha").agg(F.max_by(F.struct("snapshot_id", "status"), F.struct("created_at", "snapshot_id")).alias("_s"))
    action = F.when(F.col("_s.status") == "pending", "reuse").when(F.col("_s.status") == "cancelled", "abort").otherwise("create")
    return requests.join(held, ["repository_id", "commit_sha"], "left").select("repository_id", "commit_sha", F.col("_s.snapshot_id").alias("snapshot_id"), action.alias("action"))


def resolve_revisions(asked: DataFrame, commits: DataFrame) -> DataFrame:
    """asked(rev), a sha or a sha with ^ for its parent, with the commit (sha) or what is missing. commits(sha, parent). [S5]"""
    known = commits.select(F.col("sha").alias("_base"), F.col("parent").alias("_parent"))
    found = asked.withColumn("_want", F.regexp_replace("rev", r"\^$", "")).join(known, F.col("_want") == F.col("_base"), "left")
    up = F.endswith("rev", F.lit("^"))
    problem = F.when(F.col("_base").isNull(), "no commit").when(up & F.col("_parent").isNull(), "no parent")
    return found.select("rev", F.when(up, F.col("_parent")).otherwise(F.col("_base")).alias("sha"), problem.alias("problem"))


def choose_backends(sets: DataFrame, backends: DataFrame) -> DataFrame:
    """sets(set_name) with the first backend(place, backend, set_name) of the same name. [R38]"""
    return sets.join(backends.groupBy("set_name").agg(F.min_by("backend", "place").alias("backend")), "set_name", "left")


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """Parents with their children as a sorted array of structs. [I24]"""
    rest = [c for c in children.columns if c != key and c not in order]
    packed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    return parents.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))


def in_classes(symbols: DataFrame) -> DataFrame:
    """Symbols whose parent is a class. [J21]"""
    classes = symbols.filter("kind = 'class'").select(F.col("symbol_id").alias("_p"))
    return symbols.join(classes, F.col("parent_symbol_id") == F.col("_p"), "left_semi")


def chunk_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks with the symbol of exactly their lines, the last one of several. [J17]"""
    at = symbols.groupBy("file_id", "start_line", "end_line").agg(F.max("symbol_id").alias("exact_symbol_id"))
    return chunks.join(at, ["file_id", "start_line", "end_line"], "left")
