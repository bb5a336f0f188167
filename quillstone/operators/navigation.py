"""Navigation of an index by name: one function per tool, each giving fragments.

A fragment is (path, start_line, end_line, text, role, title).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as K
from quillstone.functions import text as T
from quillstone.operators import filters, graph, lines, review, search, windows
from quillstone.operators.digests import files_by_directory, files_by_language, project_totals

TEXT_CHARS = 4000


def rendered(text: Column, signature: Column, docstring: Column, neighbour: bool) -> Column:
    """Text or signature of a symbol; of a neighbour its signature and docstring. [R26, R45]"""
    if neighbour:
        quoted = F.concat(F.lit('"""'), docstring, F.lit('"""'))
        return T.clip(F.concat_ws("\n", signature, F.when(docstring != "", quoted)), TEXT_CHARS)
    return T.clip(F.coalesce(F.nullif(text, F.lit("")), signature), TEXT_CHARS)


def fragments(df: DataFrame, role: str, title: Column, text: Column | None = None) -> DataFrame:
    return df.select("path", "start_line", "end_line", (F.col("text") if text is None else text).alias("text"), F.lit(role).alias("role"), title.alias("title"))


def search_code(chunks: DataFrame, files: DataFrame, query: str, k: int = 10, languages=()) -> DataFrame:
    """Fragments of the first stage of a query with any hit. [R22, R6]"""
    return staged_fragments(chunks, files, *search.query_stages(query), k, languages)


def staged_fragments(chunks: DataFrame, files: DataFrame, exact: list[list[str]], substring: str | None, split: list[str], k: int, languages=()) -> DataFrame:
    held = chunks.join(filters.of_languages(filters.live(files), languages).select("file_id", "path"), "file_id")
    hits = search.by_staged_terms(held, "chunk_id", "content", exact, substring, split, k)
    return fragments(held.join(hits, "chunk_id").withColumn("text", F.col("content")), "match", F.col("chunk_id").cast("string"))


def search_documents(chunks: DataFrame, files: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Only files of document languages; the filter comes before the limit. [R25, R36]"""
    return search_code(chunks, files, query, k, K.DOCUMENT_LANGUAGES)


def definition(symbols: DataFrame, chunks: DataFrame, files: DataFrame, name: str, k: int = 10) -> DataFrame:
    """Symbols of a name with their text, exact names first. [R15, R22]"""
    q = F.col("qualified_name")
    found = symbols.filter(filters.name_matches(q, name)).join(filters.live(files).select("file_id", "path"), "file_id")
    found = found.orderBy(*windows.name_order(name, q), "symbol_id").limit(k).join(lines.symbol_text(chunks), "symbol_id", "left")
    return fragments(found, "definition", q, rendered(F.col("text"), F.col("signature"), F.col("docstring"), neighbour=False))


def related(symbols: DataFrame, edges: DataFrame, files: DataFrame, name: str, kinds=("calls",), incoming: bool = True, k: int = 20) -> DataFrame:
    """Callers, callees or other references of a name. [R19, R20, R22]"""
    seeds = symbols.filter(filters.name_matches(F.col("qualified_name"), name)).select("symbol_id")
    found = graph.with_symbols(graph.neighbours(edges, seeds, kinds, incoming), symbols, filters.live(files), k)
    return fragments(found, "reference" if incoming else "callee", F.col("qualified_name"), rendered(F.lit(""), F.col("signature"), F.col("docstring"), neighbour=True))


def hidden_kinds(symbols: DataFrame, edges: DataFrame, name: str, shown: str = "calls") -> DataFrame:
    """Kinds of edges that a listing left out, the most frequent first. [R21, R22]"""
    seeds = symbols.filter(filters.name_matches(F.col("qualified_name"), name)).select("symbol_id")
    return graph.edge_kinds(edges, seeds).filter(F.col("kind") != shown).orderBy(F.desc("n"), "kind")


def references(symbols: DataFrame, edges: DataFrame, files: DataFrame, name: str, relation: str | None = None, k: int = 20) -> DataFrame:
    """What refers to a name by any relation, or by one. [R20, R22]"""
    return related(symbols, edges, files, name, (relation,) if relation else (), True, k)


def file_context(symbols: DataFrame, files: DataFrame, path: str, first: int, last: int, k: int = 60) -> DataFrame:
    """Symbols of a file that cover a range of lines. [R13, R22]"""
    return outline(symbols.filter(filters.overlaps(F.col("start_line"), F.col("end_line"), F.lit(first), F.lit(last))), files, path, k)


def outline(symbols: DataFrame, files: DataFrame, path: str, k: int = 200) -> DataFrame:
    """[R17, T8]"""
    return symbols.join(files.filter(F.col("path") == path).select("file_id"), "file_id", "left_semi").orderBy("start_line", "end_line", "symbol_id").limit(k)


def read_file(chunks: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """[R18, R22]"""
    own = chunks.join(filters.live(files).filter(F.col("path") == path).select("file_id", "path"), "file_id")
    whole = lines.reassembled(own.select("path", "start_line", "content"), ["path"])
    return fragments(whole.withColumnRenamed("first_line", "start_line").withColumnRenamed("last_line", "end_line"), "file", F.col("path"))


def find_symbol(symbols: DataFrame, query: str, k: int | None = 20) -> DataFrame:
    """The k best symbols by score; all hits without a k. [R12, R22]"""
    named = symbols.withColumn("_text", T.search_text(F.col("qualified_name"), F.col("signature"), F.col("docstring")))
    exact, _, split = search.query_stages(query)
    return named.drop("_text").join(search.by_staged_terms(named, "symbol_id", "_text", exact, None, split, k), "symbol_id")


def list_files(files: DataFrame, pattern: str, k: int = 5) -> DataFrame:
    """[R14, R22]"""
    return filters.live(files).filter(filters.path_matches(F.col("path"), pattern)).orderBy(*windows.path_order(pattern, F.col("path"))).limit(k)


def describe(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Totals, languages and directories of an index as (section, name, files). [R16]"""
    totals = project_totals(files, symbols).select(F.explode(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(c).alias("name"), F.col(c).alias("files")) for c in ("files", "symbols")])).alias("x")).select("x.*")
    by_language = files_by_language(files).select(F.lit("language").alias("section"), F.col("language").alias("name"), "files")
    return totals.unionByName(by_language).unionByName(files_by_directory(files).select(F.lit("directory").alias("section"), F.col("directory").alias("name"), "files"))


def resolve_path(files: DataFrame, asked: str) -> DataFrame:
    """One row (path): the only file that a path or else its base name names; null if several do, or none. [R23]"""
    clean = asked.strip().lstrip("/")
    whole, base = (F.when(filters.path_matches(F.col("path"), x), F.col("path")) for x in (clean, clean.rsplit("/", 1)[-1]))
    counted = filters.live(files).agg(F.count(whole).alias("a"), F.min(whole).alias("one_a"), F.count(base).alias("b"), F.min(base).alias("one_b"))
    return counted.select(F.when(F.col("a") == 1, F.col("one_a")).when((F.col("a") == 0) & (F.col("b") == 1), F.col("one_b")).alias("path"))


def suggest_paths(files: DataFrame, asked: str, k: int = 5) -> DataFrame:
    """Up to k files for a path that names none: by its base name, then by its stem. [R24]"""
    name = asked.strip().rsplit("/", 1)[-1]
    stem = re.sub(r"\.[^.]*$", "", name)
    best = F.when(filters.path_matches(F.col("path"), name), 0).when(F.contains("path", F.lit(stem)) & F.lit(bool(stem)), 1)
    return filters.live(files).withColumn("_r", best).filter("_r IS NOT NULL").orderBy("_r", F.length("path"), "path").limit(k).drop("_r")


def grep_windows(files: DataFrame, pattern: str, kind: str = "search", k: int = 20) -> DataFrame:
    """Windows around matching lines of a working tree: search, definition, references, subclasses, importers, raisers or context. [R35, R40]"""
    before, after = {"search": (2, 2), "definition": (1, 40), "context": (20, 20)}.get(kind, (1, 1))
    rows = lines.numbered_lines(files.select("path", "content"))
    name = re.escape(pattern)
    regex = {
        "definition": rf"({'|'.join(K.DEFINITION_WORDS)})\s+{name}\b", "subclasses": rf"\bclass\s+\w+\s*(\([^)]*\b{name}\b|extends\s+{name}\b)",
        "importers": rf"\b(import|from|require)\b.*\b{name}\b", "raisers": rf"\b(raise|throw)\s+(new\s+)?([\w.]+\.)?{name}\b",
    }.get(kind, rf"\b{name}\b")
    hits = rows.filter(F.col("line").rlike(regex))
    if kind == "references":
        hits = hits.filter(~T.is_definition_line(F.col("line")))
    hits = windows.first_per_key(hits, ["path"], F.col("number"), n=5).orderBy("path", "number").limit(k)
    return lines.windows_around(files, hits.select("path", F.col("number").alias("hit")), before, after)


def grep_outline(files: DataFrame, path: str, k: int = 60) -> DataFrame:
    """Definition lines of a file of a working tree, without an index. [R35, R17]"""
    rows = lines.numbered_lines(files.filter(F.col("path") == path).select("path", "content"))
    return rows.filter(T.is_definition_line(F.col("line"))).orderBy("number").limit(k)


def diff_context(changed: DataFrame, symbols: DataFrame, edges: DataFrame, similar: DataFrame, limit: int = 2000, each: int = 12) -> DataFrame:
    """Pieces of context per file within a token budget: changed symbols, callees, callers, then similar code. [R27]

    changed(key, symbol_id); symbols(symbol_id, tokens, path, start_line, ...); similar(key, symbol_id, score). What a symbol
    has is joined to edges before they become pieces, and all pieces are shuffled once, by their file.
    """
    known = symbols.groupBy("symbol_id").agg(F.min(F.struct("path", "start_line", "tokens")).alias("_x"))
    asked = changed.select("key", "symbol_id", F.count("*").over(Window.partitionBy("key")).alias("_n"))
    calls = edges.filter("kind = 'calls'").filter(F.col("source_symbol_id").isNotNull() & F.col("target_symbol_id").isNotNull())
    # Two symbols may be joined by several edges, and each of them takes a place.
    calls = calls.groupBy("source_symbol_id", "target_symbol_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("confidence")), False), 1, each).alias("_scores"))
    ends = [calls.select(F.col(a).alias("_side"), F.lit(origin).alias("origin"), "_scores", F.col(b).alias("symbol_id")) for origin, a, b in ((1, "source_symbol_id", "target_symbol_id"), (2, "target_symbol_id", "source_symbol_id"))]
    near = ends[0].unionByName(ends[1]).join(known, "symbol_id", "left")
    # A file takes `each` neighbours beside its own symbols, so of one symbol no more than these and as many as the file has symbols.
    few = windows.first_per_key(near, ["_side", "origin"], F.desc(F.col("_scores")[0]), F.col("symbol_id"), n=2 * each)
    meet = lambda rows, met: rows.select("key", F.col("symbol_id").alias("_side")).join(met, "_side").drop("_side")
    found = meet(asked.filter(F.col("_n") <= each), few).unionByName(meet(asked.filter(F.col("_n") > each), near))
    found = found.select("key", "symbol_id", "origin", "_x", F.explode("_scores").alias("_s")).select("key", "symbol_id", "origin", F.col("_s.confidence").alias("_score"), "_x")
    own = changed.select("key", "symbol_id", F.lit(0).alias("origin"), F.lit(None).cast("double").alias("_score"))
    alike = similar.select("key", "symbol_id", F.lit(3).alias("origin"), F.col("score").alias("_score"))
    pieces = found.unionByName(own.unionByName(alike).join(known, "symbol_id", "left")).repartition("key")
    # A changed symbol is no neighbour; null files are not compared.
    first = F.min("origin").over(Window.partitionBy("key", "symbol_id"))
    pieces = pieces.withColumn("_first", first).filter((F.col("origin") == 0) | (F.col("_first") > 0) | F.col("key").isNull())
    place = F.row_number().over(Window.partitionBy("key", "origin").orderBy(F.desc("_score"), "symbol_id"))
    most = F.when(F.col("origin") == 3, each // 2).otherwise(each)
    pieces = pieces.withColumn("_place", place).filter((F.col("origin") == 0) | (F.col("_place") <= most)).filter("_x IS NOT NULL")
    pieces = pieces.select("key", "origin", F.col("symbol_id").cast("string").alias("piece_id"), "_x.*")
    return review.take_within_budget(pieces, "key", ["origin", "path", "start_line"], limit)


#: Tools by name. [R44]
TOOLS = {
    "search_code": search_code, "get_definition": definition, "find_callers": related, "find_references": references, "get_file_context": file_context, "read_file": read_file, "get_file_outline": outline,
    "find_symbol": find_symbol, "project_docs": search_documents, "describe_repository": describe, "list_files": list_files,
}
