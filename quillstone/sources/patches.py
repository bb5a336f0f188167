"""Unified diffs as tables of files and hunks: lines with running counts, no parser.

A line that begins with ``@@`` is a hunk's header wherever it stands, as no line of a hunk begins so. From there
lines belong to the hunk until it has the old and new lines that its header names; running sums tell where that is. All other
lines may name files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$"
GIT = r"^diff --git a/(.*) b/(.*)$"
#: Stands for /dev/null among names.
NOWHERE = ""


def _name(text: Column) -> Column:
    """A file's name after a marker of four characters."""
    name = F.trim(F.split(F.substring(text, 5, 1 << 20), "\t")[0])
    return F.when(name == "/dev/null", NOWHERE).otherwise(F.regexp_replace(name, "^[ab]/", ""))


def _count(place: int) -> Column:
    """A number of lines in a header; one where it is left out."""
    found = F.regexp_extract("line", HUNK, place)
    return F.when(found == "", 1).otherwise(found.cast("int"))


def tagged_lines(patches: DataFrame) -> DataFrame:
    """Lines of patches(patch_id, patch) with the number of their hunk and file, whether they are the hunk's own, and what they name."""
    rows = patches.select("patch_id", F.posexplode(F.split(F.coalesce("patch", F.lit("")), "\n")).alias("at", "line"))
    order = Window.partitionBy("patch_id").orderBy("at")
    rows = rows.withColumn("header", F.col("line").rlike(HUNK)).withColumn("hunk", F.sum(F.col("header").cast("int")).over(order))
    rows = rows.withColumn("n_old", F.when(F.col("header"), _count(2))).withColumn("n_new", F.when(F.col("header"), _count(4)))
    inside = Window.partitionBy("patch_id", "hunk").orderBy("at")
    mark, before = F.substring("line", 1, 1), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n_old", F.first("n_old").over(inside)).withColumn("n_new", F.first("n_new").over(inside))
    rows = rows.withColumn("old", (~F.col("header") & mark.isin("", " ", "-")).cast("int")).withColumn("new", (~F.col("header") & mark.isin("", " ", "+")).cast("int"))
    short = lambda used, n: F.coalesce(F.sum(used).over(before), F.lit(0)) < F.col(n)
    rows = rows.withColumn("body", F.coalesce((F.col("hunk") > 0) & ~F.col("header") & (short("old", "n_old") | short("new", "n_new")), F.lit(False)))
    line = F.col("line")
    kind = F.when(F.col("header"), "hunk").when(F.col("body"), None).when(line.startswith("diff --git "), "git").when(line.startswith("+++ "), "new")
    kind = kind.when(line.startswith("--- "), "old").when(line.startswith("rename from "), "from").when(line.startswith("rename to "), "to")
    rows = rows.withColumn("kind", kind)
    last = F.last(F.when(F.col("kind").isin("hunk", "git", "new"), F.col("kind")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.col("kind") == "git") | ((F.col("kind") == "new") & (last.isNull() | (last == "hunk")))
    rows = rows.withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int"))
    return rows.withColumn("file", F.sum("begins").over(order)).withColumn("old_name", F.last(F.when(F.col("kind") == "old", _name(line)), ignorenulls=True).over(order))


def parse_patches(patches: DataFrame) -> DataFrame:
    """patches(patch_id, patch) -> one row per file with its hunks, or one with an error. [S3, S4, S9, S10]"""
    rows = tagged_lines(patches)
    line, body = F.col("line"), F.col("body")
    mark = F.substring("line", 1, 1)
    head = F.max(F.when(F.col("header"), F.struct(line, "at", "file")))
    numbers = [F.regexp_extract(F.col("h.line"), HUNK, p).cast("int").alias(n) for p, n in ((1, "old_start"), (3, "new_start"))]
    used = lambda c: F.coalesce(F.sum(F.when(body, F.col(c))), F.lit(0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body | F.col("header"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    hunks = rows.filter("hunk > 0").groupBy("patch_id", "hunk").agg(
        head.alias("h"), F.max("n_old").alias("old_lines"), F.max("n_new").alias("new_lines"), used("old").alias("_old"), used("new").alias("_new"), text.alias("patch_text"),
        F.max(body & ~mark.isin("", " ", "+", "-", "\\")).alias("_stray"), F.count_if(body & (mark == "+")).cast("int").alias("_plus"), F.count_if(body & (mark == "-")).cast("int").alias("_minus"),
    )
    problem = F.when(F.col("h.file") == 0, "a hunk without a file").when(F.col("_stray") | (F.col("_old") < F.col("old_lines")) | (F.col("_new") < F.col("new_lines")), "a hunk is shorter than its header says")
    hunks = hunks.withColumn("problem", problem.when((F.col("_old") > F.col("old_lines")) | (F.col("_new") > F.col("new_lines")), "a hunk is longer than its header says"))
    broken = hunks.filter("problem IS NOT NULL").groupBy("patch_id").agg(F.min_by("problem", "hunk").alias("error"))
    hunk = F.struct(numbers[0], "old_lines", numbers[1], "new_lines", F.regexp_extract(F.col("h.line"), HUNK, 5).alias("header"), "patch_text")
    held = hunks.groupBy("patch_id", F.col("h.file").alias("file")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hunk", hunk.alias("x")))), lambda x: x["x"]).alias("hunks"), F.sum("_plus").cast("int").alias("added_lines"), F.sum("_minus").cast("int").alias("removed_lines")
    )
    last = lambda kind, value: F.max_by(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, F.col("at")))
    git = lambda p: F.nullif(F.regexp_extract("line", GIT, p), F.lit(""))
    files = rows.filter("file > 0").groupBy("patch_id", "file").agg(
        last("new", _name(line)).alias("_new"), last("new", F.coalesce("old_name", F.lit(NOWHERE))).alias("_old"), last("git", git(1)).alias("_a"), last("git", git(2)).alias("_b"),
        last("from", F.substring(line, 13, 1 << 20)).alias("_from"), last("to", F.substring(line, 11, 1 << 20)).alias("_to"),
    )
    known = lambda side, plain: F.when(F.col("_new").isNotNull(), F.nullif(F.col(side), F.lit(NOWHERE))).otherwise(plain)
    old, new = known("_old", F.coalesce("_from", "_a")), known("_new", F.coalesce("_to", "_b"))
    kind = F.when(F.col("_from").isNotNull(), "renamed").when(old.isNull(), "added").when(new.isNull(), "deleted").otherwise("modified")
    none = F.array().cast(held.schema["hunks"].dataType)
    zero = lambda c: F.coalesce(c, F.lit(0))
    good = files.join(held, ["patch_id", "file"], "left").join(broken, "patch_id", "left_anti").select(
        "patch_id", F.coalesce(new, old).alias("path"), F.when(F.col("_from").isNotNull(), old).alias("previous_path"), kind.alias("change_type"),
        zero("added_lines").alias("added_lines"), zero("removed_lines").alias("removed_lines"), F.lit(None).cast("string").alias("error"), F.coalesce("hunks", none).alias("hunks"),
    )
    null = F.lit(None)
    bad = broken.select(
        "patch_id", null.cast("string").alias("path"), null.cast("string").alias("previous_path"), null.cast("string").alias("change_type"),
        null.cast("int").alias("added_lines"), null.cast("int").alias("removed_lines"), "error", none.alias("hunks"),
    )
    return good.unionByName(bad)


def hunks_of(files: DataFrame) -> DataFrame:
    """One row per hunk."""
    return files.select("patch_id", "path", F.explode("hunks").alias("h")).select("patch_id", "path", "h.*")
