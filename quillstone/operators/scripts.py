"""JavaScript and TypeScript files as symbols and edges, by patterns on their lines and the depth of their braces.

Strings, templates, comments and regular expressions are found over the whole file first, from its beginning on, so
those that go over lines hold no definition, call or brace; a template counts as one, with the code that it quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.lines import LINE_END, points_in_ranges
from quillstone.operators.sweep import innermost
from quillstone.storage import kept

NAME = r"[A-Za-z_$][\w$]*"
HEAD = r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
FUNCTION = rf"{HEAD}function\s*\*?\s*({NAME})"
BOUND = rf"{HEAD}(?:const|let|var)\s+({NAME})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|{NAME}\s*=>)"
CLASS = rf"{HEAD}(?:class|interface|type|enum)\s+({NAME})"
METHOD = rf"^\s+(?:(?:public|private|protected|static|async|override|get|set)\s+)*({NAME})\s*\([^;{{}}]*\)\s*(?::[^={{]+)?\{{"
IMPORT = r"""^\s*(?:import|export)\b.*?\bfrom\s+['"]([^'"]+)['"]"""
CALL = rf"(?<![\w$.])((?:{NAME}\.)*{NAME})\s*\("
#: What holds no code: strings, templates, comments, and regular expressions where an operand may stand. Possessive, so that nothing is tried twice.
QUOTED = (
    r'''(?s)"[^"\\\r\n]*+(?:\\.[^"\\\r\n]*+)*+"?|'[^'\\\r\n]*+(?:\\.[^'\\\r\n]*+)*+'?|`[^`\\]*+(?:\\.[^`\\]*+)*+`?|//[^\r\n]*+|/\*(?:(?!\*/).)*+(?:\*/)?'''
    r"""|(?<=(?:[(,=:\[!&|?{};]|\breturn)[ \t]{0,4})/(?![*/])[^/\\\r\n\[]*+(?:(?:\\.|\[[^\]\\\r\n]*+(?:\\.[^\]\\\r\n]*+)*+\])[^/\\\r\n\[]*+)*+/[a-z]*"""
)
#: Words before a parenthesis that name no function.
NOT_CALLED = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "constructor", "import", "require")


def module(path: Column) -> Column:
    """Module of a script; index names its folder."""
    return F.regexp_replace(F.regexp_replace(T.module_path(path), r"(^|\.)index$", ""), "^$", "index")


def code_of(content: Column) -> Column:
    """The file with a space and the line ends of each string, template, comment and regular expression in its place."""
    blank = F.transform(F.regexp_extract_all(content, F.lit(QUOTED), F.lit(0)), lambda t: F.concat(F.lit(" "), F.regexp_replace(t, r"[^\r\n]+", "")))
    pieces = F.zip_with(F.split(content, QUOTED), blank, lambda code, gap: F.concat(code, F.coalesce(gap, F.lit(""))))
    return F.array_join(pieces, "")


def lines_of(files: DataFrame) -> DataFrame:
    """(path, number, line, code, opens, before, after): lines of scripts, what of each is code, and the depth of braces before and after it."""
    rows = files.filter(F.col("language").isin("javascript", "typescript")).select("path", "content", code_of(F.col("content")).alias("_code"))
    both = F.arrays_zip(F.split("content", LINE_END).alias("line"), F.split("_code", LINE_END).alias("code"))
    rows = rows.select("path", F.posexplode(both).alias("_at", "_x")).select("path", (F.col("_at") + 1).alias("number"), "_x.line", "_x.code")
    count = lambda c: F.length("code") - F.length(F.replace("code", F.lit(c)))
    rows = rows.withColumn("opens", count("{")).withColumn("_turn", count("{") - count("}"))
    return rows.withColumn("after", F.sum("_turn").over(Window.partitionBy("path").orderBy("number"))).withColumn("before", F.col("after") - F.col("_turn")).drop("_turn")


def definitions(files: DataFrame) -> DataFrame:
    """(path, kind, name, qualified_name, start_line, end_line): classes, functions and methods; nested ones follow their owners. [I27]

    A definition ends where the braces are as deep again as before it: closing lines are dealt by the levels that they close.
    """
    return definitions_in(lines_of(files))


def definitions_in(rows: DataFrame) -> DataFrame:
    """definitions of lines that lines_of gave. [I27]"""
    pick = lambda p: F.nullif(F.regexp_extract("code", p, 1), F.lit(""))
    method = F.when(~pick(METHOD).isin(*NOT_CALLED) | (pick(METHOD) == "constructor"), pick(METHOD))
    found = rows.withColumn("name", F.coalesce(pick(CLASS), pick(FUNCTION), pick(BOUND), method)).filter("name IS NOT NULL")
    kind = F.when(pick(CLASS).isNotNull(), "class").when(F.coalesce(pick(FUNCTION), pick(BOUND)).isNotNull(), "function").otherwise("method")
    found = found.select("path", kind.alias("kind"), "name", F.col("number").alias("start_line"), F.col("before").alias("level"), (F.col("after") > F.col("before")).alias("open"))
    closing = rows.filter("after < before").select("path", F.explode(F.sequence("after", F.col("before") - 1)).alias("level"), "number")
    events = found.filter("open").select("path", "level", F.col("start_line").alias("number"), F.lit(None).cast("int").alias("close")).unionByName(closing.withColumn("close", F.col("number")))
    ahead = Window.partitionBy("path", "level").orderBy("number", "close").rowsBetween(1, Window.unboundedFollowing)
    ends = events.withColumn("end_line", F.min("close").over(ahead)).filter("close IS NULL").select("path", "level", F.col("number").alias("start_line"), "end_line")
    last = rows.groupBy("path").agg(F.max("number").alias("_last"))
    placed = found.join(ends, ["path", "level", "start_line"], "left").join(last, "path").withColumn("end_line", F.when(~F.col("open"), F.col("start_line")).otherwise(F.coalesce("end_line", "_last")))
    placed = placed.select("path", "kind", "name", "start_line", "end_line")
    outer = placed.select("path", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"), F.col("name").alias("_outer"))
    inside = points_in_ranges(placed.withColumn("at", F.col("start_line")), outer, "path").filter("r_start < start_line")
    owners = inside.groupBy("path", "start_line").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_start", "_outer"))), lambda x: x["_outer"]).alias("_owners"))
    named = placed.join(owners, ["path", "start_line"], "left")
    full = F.array_join(F.concat(F.array(module(F.col("path"))), F.coalesce("_owners", F.array().cast("array<string>")), F.array("name")), ".")
    return named.select("path", "kind", "name", full.alias("qualified_name"), "start_line", "end_line")


def symbols(files: DataFrame) -> DataFrame:
    """definitions and a module for each script. [I5, I27]"""
    scripts = files.filter(F.col("language").isin("javascript", "typescript"))
    at = module(F.col("path"))
    whole = scripts.select("path", F.lit("module").alias("kind"), T.last_segment(at).alias("name"), at.alias("qualified_name"), F.lit(1).alias("start_line"), F.size(F.split("content", "\r\n|\r|\n")).alias("end_line"))
    return whole.unionByName(definitions(files))


def imports(files: DataFrame) -> DataFrame:
    """(path, source_qualified_name, target): what each script imports. [I5]"""
    return imports_in(lines_of(files))


def imports_in(rows: DataFrame) -> DataFrame:
    """A line imports if it begins so in code; the module's name is a string. [I5]"""
    target = F.when(F.col("code").rlike(r"^\s*(?:import|export)\b"), F.regexp_extract("line", IMPORT, 1))
    return rows.select("path", module(F.col("path")).alias("source_qualified_name"), target.alias("target")).filter("target <> ''").distinct()


def calls(files: DataFrame) -> DataFrame:
    """(path, source_qualified_name, target): calls by their innermost definition, else by the module; this is the owner's class. [I5]"""
    rows = kept(lines_of(files), "lines")
    return calls_in(rows, kept(definitions_in(rows), "definitions"))


def calls_in(rows: DataFrame, defs: DataFrame) -> DataFrame:
    named = F.explode(F.regexp_extract_all("code", F.lit(CALL), F.lit(1)))
    found = rows.select("path", F.col("number").alias("at"), named.alias("target")).filter(~F.substring_index("target", ".", -1).isin(*NOT_CALLED)).distinct()
    # A definition's own name before its parameters is no call.
    found = found.join(defs.select("path", F.col("start_line").alias("at"), F.col("name").alias("target")), ["path", "at", "target"], "left_anti")
    ranges = defs.select("path", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"), F.col("qualified_name").alias("range_id"))
    points = found.withColumn("point_id", F.col("at"))
    owner = innermost(ranges, points.select("path", "point_id", "at").distinct(), "path").select("path", F.col("point_id").alias("at"), F.col("range_id").alias("_owner"))
    both = found.join(owner, ["path", "at"], "left")
    source = F.coalesce("_owner", module(F.col("path")))
    own = F.concat(F.regexp_replace(source, r"\.[^.]+$", ""), F.substring(F.col("target"), 5, 1 << 20))
    return both.select("path", source.alias("source_qualified_name"), F.when(F.col("target").startswith("this."), own).otherwise(F.col("target")).alias("target")).distinct()


def edges(files: DataFrame) -> DataFrame:
    """(path, source_qualified_name, target_qualified_name, kind): imports and calls, each once; lines and definitions are made once. [I5]"""
    rows = kept(lines_of(files), "lines")
    tagged = lambda df, kind: df.select("path", "source_qualified_name", F.col("target").alias("target_qualified_name"), F.lit(kind).alias("kind"))
    return tagged(imports_in(rows), "imports").unionByName(tagged(calls_in(rows, kept(definitions_in(rows), "definitions")), "calls"))
