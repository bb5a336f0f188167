"""Lines, intervals and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import many_tasks

LINE_END = "\r\n|\r|\n"
LARGE_BYTES, LARGE_LINES = 512 * 1024, 5000
WINDOW_LINES = 400
#: Rows of equal ranges that are joined as one.
PACK = 1024
#: More partitions than any job has.
AS_MANY = 1_000_000


def numbered_lines(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row per line, numbered from one."""
    keys = [c for c in files.columns if c != text_col]
    return files.select(*keys, F.posexplode(F.split(text_col, LINE_END)).alias("_at", "line")).withColumn("number", F.col("_at") + 1).drop("_at")


def grep(files: DataFrame, pattern: str, fixed: bool, k: int, per_file: int = 5) -> DataFrame:
    """(path, number, line): matching lines in path order, per_file of a file, k in all. [S7, W6, R35]"""
    hit = F.contains("line", F.lit(pattern)) if fixed else F.col("line").rlike(pattern)
    found = numbered_lines(files.select("path", "content")).filter(hit)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("number"))
    return found.withColumn("_rn", rank).filter(F.col("_rn") <= per_file).orderBy("path", "number").limit(k).select("path", "number", "line")


def parse_grep(output: DataFrame, column: str = "value") -> DataFrame:
    """rev:path:line:text rows; those without a number are skipped. [S8]"""
    form = r"^[^:]*:([^:]*):(\d+):(.*)$"
    return output.filter(F.col(column).rlike(form)).select(
        F.regexp_extract(column, form, 1).alias("path"), F.regexp_extract(column, form, 2).cast("int").alias("number"), F.regexp_extract(column, form, 3).alias("line")
    )


def reassembled(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each key from overlapping chunks: of a line the chunk that starts first wins. [A21, R18]"""
    lines = chunks.select(*keys, "start_line", F.posexplode(F.split("content", "\n")).alias("_at", "line")).withColumn("number", F.col("start_line") + F.col("_at"))
    one = lines.groupBy(*keys, "number").agg(F.min_by("line", F.struct("start_line", "line")).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n")
    return one.groupBy(*keys).agg(F.min("number").alias("first_line"), F.max("number").alias("last_line"), joined.alias("text"))


def symbol_text(chunks: DataFrame) -> DataFrame:
    """Chunks of each symbol in line order. [A20]"""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "content"))), lambda x: x["content"]), "\n")
    return chunks.filter("symbol_id IS NOT NULL").groupBy("symbol_id").agg(joined.alias("text"))


def windows_around(files: DataFrame, hits: DataFrame, before: int, after: int) -> DataFrame:
    """Lines around each hit (path, hit) of files(path, content), clamped to the file: a slice of its lines. [R40]"""
    split = files.join(hits.groupBy("path").agg(F.collect_set("hit").alias("_hits")), "path").select("path", "_hits", F.split("content", LINE_END).alias("_l"))
    first = F.greatest(F.lit(1), F.col("hit") - before)
    last = F.least(F.size("_l"), F.col("hit") + after)
    return split.select("path", F.explode("_hits").alias("hit"), "_l").select(
        "path", "hit", first.alias("first_line"), last.alias("last_line"), F.array_join(F.slice("_l", first, last - first + 1), "\n").alias("text")
    )


def content_window(content: Column, start: Column, end: Column | None = None) -> Column:
    """Lines start to end, at most WINDOW_LINES. [D4]"""
    lines = F.split(content, "\n")
    first = F.greatest(start, F.lit(1))
    last = F.least(F.size(lines), first + WINDOW_LINES - 1, *([end] if end is not None else []))
    return F.when(last >= first, F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")).otherwise("")


def _packed(rows: DataFrame, key: str, start: str, end: str, out: str) -> DataFrame:
    """Rows of equal (key, start, end) as arrays of about PACK rows; a class or a row that is repeated very often is cut into more."""
    rest = [c for c in rows.columns if c not in (key, start, end)]
    times = rows.filter(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*rows.columns).agg(F.count("*").alias("_m"))
    sizes = times.groupBy(key, start, end).agg(F.sum("_m").alias("_n"))
    cut = times.join(sizes, [key, start, end]).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / PACK))))
    # A single column needs no struct around it, which would take twice its place.
    copies = F.array_repeat(F.struct(*rest) if len(rest) > 1 else F.col(rest[0]) if rest else F.lit(True), F.least(F.lit(PACK), F.col("_m") - F.col("_copy") * PACK).cast("int"))
    part = F.pmod(F.xxhash64(*rest, "_copy"), F.ceil(F.col("_n") / PACK)).alias(f"{out}_part")
    return cut.groupBy(key, start, end, part).agg(F.flatten(F.collect_list(copies)).alias(out))


def overlap_join(left: DataFrame, right: DataFrame, key: str, bin_lines: int = 64) -> DataFrame:
    """left(key, l_start, l_end) with right(key, r_start, r_end) that overlaps it. [J14, R13, I26]

    Rows of equal ranges are packed first, so that ranges are compared once a pack and not once a pair of rows. Packs are cut into
    bins of lines and joined on (key, bin); pairs of packs are then dealt to all tasks and only there become pairs of rows, so
    neither a file with very many ranges nor a very frequent range stays in one task. A task holds the rows of one left row and one
    pack at a time. Columns beside the ranges must be groupable.
    """
    binned = lambda df, s, e: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / bin_lines), F.floor(F.greatest(F.col(e), F.col(s)) / bin_lines))))
    both = binned(_packed(left, key, "l_start", "l_end", "_l"), "l_start", "l_end").join(binned(_packed(right, key, "r_start", "r_end", "_r"), "r_start", "r_end"), [key, "_bin"])
    both = both.filter((F.col("l_start") <= F.col("r_end")) & (F.col("l_end") >= F.col("r_start")))
    # Of the bins that a pair shares, the first one counts.
    both = both.filter(F.col("_bin") == F.greatest(F.floor(F.col("l_start") / bin_lines), F.floor(F.col("r_start") / bin_lines))).drop("_bin")
    dealt = both.repartition(many_tasks(left.sparkSession), key, "l_start", "l_end", "_l_part", "r_start", "r_end", "_r_part").drop("_l_part", "_r_part")
    # Steps that follow each other are compiled into one, which holds all rows that come of one row it reads: a million for two packs.
    # Coalescing to more partitions than there are leaves them as they are and parts the two steps.
    rows = dealt.withColumn("_l", F.explode("_l")).coalesce(AS_MANY).withColumn("_r", F.explode("_r"))

    def own(df: DataFrame, side: str) -> list[Column]:
        ends = (f"{side}_start", f"{side}_end")
        rest = [c for c in df.columns if c != key and c not in ends]
        return [F.col(c) if c in ends else F.col(f"_{side}.{c}") if len(rest) > 1 else F.col(f"_{side}").alias(c) for c in df.columns if c != key]

    return rows.select(key, *own(left, "l"), *own(right, "r"))


def points_in_ranges(points: DataFrame, ranges: DataFrame, key: str, how: str = "inner", bin_lines: int = 64) -> DataFrame:
    """points(key, at) with the ranges(key, r_start, r_end) that hold them, joined on (key, bin of lines) as in overlap_join."""
    r = ranges.withColumn("_r_bin", F.explode(F.sequence(F.floor(F.col("r_start") / bin_lines), F.floor(F.greatest("r_end", "r_start") / bin_lines)))).withColumnRenamed(key, "_r_key")
    inside = (F.col("at") >= F.col("r_start")) & (F.col("at") <= F.col("r_end"))
    return points.withColumn("_bin", F.floor(F.col("at") / bin_lines)).join(r, (F.col(key) == F.col("_r_key")) & (F.col("_bin") == F.col("_r_bin")) & inside, how).drop("_bin", "_r_bin", "_r_key")


def contained(points: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Points inside some range. [J15, P8]"""
    # Whether any range holds a point is decided by the distinct ones.
    return points_in_ranges(points, ranges.select(key, "r_start", "r_end").distinct(), key, "left_semi")


def hunk_bounds(hunks: DataFrame) -> DataFrame:
    """[A27]"""
    return hunks.groupBy("path").agg(
        F.coalesce(F.min(F.when(F.col("new_lines") > 0, F.col("new_start"))), F.lit(1)).alias("first_line"),
        F.coalesce(F.max(F.when(F.col("new_lines") > 0, F.col("new_start") + F.col("new_lines") - 1)), F.lit(1)).alias("last_line"),
    )


def patch_size(hunks: DataFrame) -> DataFrame:
    """Bytes, lines and whether a file is too large to review. [P12]"""
    lines = F.length("patch_text") - F.length(F.replace("patch_text", F.lit("\n"))) + 1
    sized = hunks.groupBy("path").agg(F.sum(F.octet_length("patch_text")).alias("bytes"), F.sum(lines).alias("lines"))
    return sized.withColumn("too_large", (F.col("bytes") > LARGE_BYTES) | (F.col("lines") > LARGE_LINES))


def reviewable(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """Files that are not deleted, have hunks and are not too large. [P11, P12]"""
    good = patch_size(hunks).filter("NOT too_large").select("path")
    return files.filter("change_type <> 'deleted'").join(good, "path", "left_semi")


def unified_patch(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """Patch text of each file with headers. [D2, R43]"""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("old_start", "new_start", "patch_text"))), lambda h: h["patch_text"]), "\n")
    both = files.join(hunks.groupBy("path").agg(body.alias("_body")), "path", "left")
    old = F.when(F.col("change_type") == "added", "/dev/null").otherwise(F.concat(F.lit("a/"), F.coalesce("previous_path", "path")))
    new = F.when(F.col("change_type") == "deleted", "/dev/null").otherwise(F.concat(F.lit("b/"), F.col("path")))
    text = F.concat(F.lit("--- "), old, F.lit("\n+++ "), new, F.lit("\n"), F.coalesce("_body", F.lit("")))
    return both.select("path", F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n"))).alias("patch"))


def diff_totals(files: DataFrame) -> DataFrame:
    """[A30]"""
    return files.agg(F.coalesce(F.sum("added_lines"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed_lines"), F.lit(0)).alias("removed"), (F.count("*") == 0).alias("is_empty"))


def find_by_path(files: DataFrame, asked: str) -> DataFrame:
    """The file of that path, else the only one that ends with it. [D3]"""
    tagged = files.withColumn("_exact", F.col("path") == asked).filter(F.col("_exact") | F.col("path").endswith("/" + asked))
    # One row of two counts.
    counted = tagged.join(F.broadcast(tagged.agg(F.count_if("_exact").alias("_e"), F.count("*").alias("_n"))))
    return counted.filter(F.col("_exact") | ((F.col("_e") == 0) & (F.col("_n") == 1))).drop("_exact", "_e", "_n")
