"""Code as symbols, edges and chunks: Python files by their syntax tree, other files as text.

Python reads one file at a time with the standard ast; texts are cut, and tables made, in Spark.
"""

from __future__ import annotations

import ast
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from quillstone.functions import text as T
from quillstone.functions.constants import BUILTIN_NAMES
from quillstone.operators import packing

MOST_TOKENS, LEAST_TOKENS, OVERLAP = 512, 48, 2
SYMBOL_FIELDS = ("kind", "name", "qualified_name", "signature", "docstring", "start_line", "end_line")
EDGE_FIELDS = ("source_qualified_name", "target_qualified_name", "kind", "confidence")
CHUNK_FIELDS = ("symbol", "content", "token_count", "start_line", "end_line")


def _rows(fields: tuple[str, ...], **types: DataType) -> ArrayType:
    return ArrayType(StructType([StructField(f, types.get(f, StringType())) for f in fields]))


PARSED = StructType(
    [
        StructField("path", StringType()), StructField("content", StringType()), StructField("symbols", _rows(SYMBOL_FIELDS, start_line=IntegerType(), end_line=IntegerType())),
        StructField("edges", _rows(EDGE_FIELDS, confidence=DoubleType())), StructField("chunks", _rows(CHUNK_FIELDS, token_count=IntegerType(), start_line=IntegerType(), end_line=IntegerType())),
    ]
)


def tokens(text: str) -> int:
    return max(1, round(len(text) / 3.0))


def module_of(path: str) -> str:
    parts = path.rsplit(".", 1)[0].split("/") if "." in path.rsplit("/", 1)[-1] else path.split("/")
    if "src" in parts:
        parts = parts[len(parts) - parts[::-1].index("src") :]
    return ".".join(p for p in parts if p and p != "__init__")


class Definition:
    def __init__(self, kind: str, name: str, qualified: str, node, lines: list[str], parent: str):
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        self.kind, self.name, self.qualified, self.parent, self.node = kind, name, qualified, parent, node
        self.start, self.end = first, node.end_lineno or node.lineno
        self.signature = lines[node.lineno - 1].strip()
        self.docstring = ast.get_docstring(node)


def definitions(tree: ast.Module, module: str, lines: list[str]) -> list[Definition]:
    """Classes, functions, methods and properties; nested ones follow their owner. [I2]"""
    out: list[Definition] = []

    def walk(body, owner: str, in_class: bool) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if in_class else "function"
                if kind == "method" and any(dotted(d) == "property" or (dotted(d) or "").endswith(".setter") for d in node.decorator_list):
                    kind = "property"
                name = f"{owner}.{node.name}" if owner else node.name
                out.append(Definition(kind, node.name, name, node, lines, owner))
                walk(node.body, name, kind == "class")
            else:
                for part in ("body", "orelse", "finalbody", "handlers", "cases"):
                    inner = getattr(node, part, [])
                    walk([x for h in inner for x in (h.body if isinstance(h, (ast.ExceptHandler, ast.match_case)) else [h])] if isinstance(inner, list) else [], owner, in_class)

    walk(tree.body, module, False)
    return out


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Call):
        node = node.func
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def imports_of(tree: ast.Module, module: str, is_package: bool) -> tuple[dict[str, str], list[str]]:
    """Names that imports bind, with what they stand for, and all imported names."""
    bound: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                bound[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            base = node.module or ""
            if node.level:
                up = module.split(".")[: len(module.split(".")) - node.level + is_package]
                base = ".".join([*up, *([base] if base else [])])
            for a in node.names:
                if a.name != "*":
                    bound[a.asname or a.name] = f"{base}.{a.name}" if base else a.name
    return bound, list(dict.fromkeys(bound.values()))


def edges_of(tree: ast.Module, module: str, defs: list[Definition], is_package: bool = False) -> list[tuple[str, str, str, float]]:
    """(source, target, kind, confidence), one per source, target and kind. [I4, I25]"""
    bound, imported = imports_of(tree, module, is_package)
    top = {d.name: d.qualified for d in defs if d.parent == module}
    seen: dict[tuple[str, str, str], float] = {(module, t, "imports"): 1.0 for t in imported}

    def target(raw: str | None, owner_class: str | None) -> str | None:
        if raw is None or raw in BUILTIN_NAMES:
            return None
        head, _, rest = raw.partition(".")
        if head in ("self", "cls"):
            return f"{owner_class}.{rest}" if owner_class and rest else None
        base = top.get(head) or bound.get(head)
        return ".".join(x for x in (base or head, rest) if x)

    def note(source: str, raw: str | None, kind: str, owner_class: str | None) -> None:
        if to := target(raw, owner_class):
            head = raw.split(".")[0]
            sure = 1.0 if head in bound or head in top or "." not in raw else 0.5
            seen.setdefault((source, to, kind), sure)

    for d in defs:
        owner_class = d.qualified if d.kind == "class" else d.parent if d.kind in ("method", "property") else None
        for dec in d.node.decorator_list:
            note(d.qualified, dotted(dec), "decorates", owner_class)
        if d.kind == "class":
            for base in d.node.bases:
                if isinstance(base, (ast.Name, ast.Attribute)):
                    note(d.qualified, dotted(base), "inherits", None)
        raised: set[int] = set()
        todo = deque(d.node.body)
        while todo:
            node = todo.popleft()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(node, ast.Raise) and node.exc is not None:
                note(d.qualified, dotted(node.exc), "raises", owner_class)
                raised.add(id(node.exc))
            elif isinstance(node, ast.Call) and id(node) not in raised:
                note(d.qualified, dotted(node), "calls", owner_class)
            todo += list(ast.iter_child_nodes(node))
    return [(s, t, k, c) for (s, t, k), c in seen.items()]


def by_lines(lines: list[str], start: int, end: int) -> list[tuple[int, int]]:
    """Ranges of at most MOST_TOKENS that overlap by OVERLAP lines."""
    out, a = [], start
    while a <= end:
        b, size = a, 0
        while b <= end and (b == a or size + tokens(lines[b - 1]) <= MOST_TOKENS):
            size += tokens(lines[b - 1])
            b += 1
        out.append((a, b - 1))
        if b > end:
            break
        a = max(b - OVERLAP, a + 1)
    return out


def code_chunks(content: str, module: str, defs: list[Definition]) -> list[tuple[str, str, int, int]]:
    """(symbol, text, first, last): whole definitions where they fit, else by inner definitions, else by lines. [I8, I9]"""
    lines = content.split("\n")
    cut = lambda a, b: "\n".join(lines[a - 1 : b])
    out: list[tuple[str, str, int, int]] = []

    def place(d: Definition) -> None:
        if tokens(cut(d.start, d.end)) <= MOST_TOKENS:
            out.append((d.qualified, cut(d.start, d.end), d.start, d.end))
            return
        inner = [x for x in defs if x.parent == d.qualified]
        if not inner:
            out.extend((d.qualified, cut(a, b), a, b) for a, b in by_lines(lines, d.start, d.end))
            return
        if inner[0].start > d.start:
            out.extend((d.qualified, cut(a, b), a, b) for a, b in by_lines(lines, d.start, inner[0].start - 1))
        for x in inner:
            place(x)

    tops = [d for d in defs if d.parent == module]
    for d in tops:
        place(d)
    at = 1
    for a, b in [*((d.start, d.end) for d in tops), (len(lines) + 1, len(lines) + 1)]:
        if a > at and cut(at, a - 1).strip():
            out.extend((module, cut(x, y), x, y) for x, y in by_lines(lines, at, a - 1) if cut(x, y).strip())
        at = max(at, b + 1)
    out.sort(key=lambda c: (c[2], c[3]))
    merged: list[tuple[str, str, int, int]] = []
    for symbol, text, a, b in out:
        last = merged[-1] if merged else None
        small = last and symbol != module and last[0] != module and a > last[3] and tokens(text) < LEAST_TOKENS and tokens(last[1]) < LEAST_TOKENS
        if small and tokens(cut(last[2], b)) <= MOST_TOKENS:
            shared = [x for x, y in zip(last[0].split("."), symbol.split("."), strict=False) if x == y]
            merged[-1] = (".".join(shared) or module, cut(last[2], b), last[2], b)
        else:
            merged.append((symbol, text, a, b))
    return merged


def parse_file(path: str, content: str) -> dict | None:
    """Symbols, edges and chunks of a Python file; nothing for one that does not parse. [I2, I4, I7, I8]"""
    module, lines = module_of(path), content.split("\n")
    try:
        tree = ast.parse(content)
        defs = definitions(tree, module, lines)
    except (SyntaxError, ValueError, RecursionError):
        return None
    whole = ("module", module.rsplit(".", 1)[-1], module, None, ast.get_docstring(tree), 1, len(lines))
    named = lambda rows, fields: [dict(zip(fields, r, strict=True)) for r in rows]
    return {
        "symbols": named([whole, *((d.kind, d.name, d.qualified, d.signature, d.docstring, d.start, d.end) for d in defs)], SYMBOL_FIELDS),
        "edges": named(edges_of(tree, module, defs, path.endswith("__init__.py")), EDGE_FIELDS),
        "chunks": named([(s, t, tokens(t), a, b) for s, t, a, b in code_chunks(content, module, defs)], CHUNK_FIELDS),
    }


def parse(files: DataFrame) -> DataFrame:
    """(path, content, symbols, edges, chunks): each file parsed once; content stays where a file is text or does not parse. [I7]

    Keep the result where more than one of symbols, edges and chunks is read from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                done = parse_file(path, content or "") if language == "python" else None
                rows.append({"path": path, "content": None if done else content or "", **(done or {})})
            yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(PARSED))

    return files.select("path", "language", "content").mapInArrow(run, PARSED)


def symbols(parsed: DataFrame) -> DataFrame:
    """Symbols of parsed files, a module for each text. [I2]"""
    text = F.col("content").isNotNull()
    module = T.module_path(F.col("path"))
    lines = F.size(F.split("content", "\n"))
    none = F.lit(None).cast("string")
    whole = F.struct(F.lit("module").alias("kind"), T.last_segment(module).alias("name"), module.alias("qualified_name"), none.alias("signature"), none.alias("docstring"), F.lit(1).alias("start_line"), lines.alias("end_line"))
    return parsed.select("path", F.explode(F.when(text, F.array(whole)).otherwise(F.col("symbols"))).alias("s")).select("path", "s.*")


def edges(parsed: DataFrame) -> DataFrame:
    """References of parsed files. [I4, I25]"""
    return parsed.select("path", F.explode("edges").alias("e")).select("path", "e.*")


def chunks(parsed: DataFrame) -> DataFrame:
    """Chunks of parsed files by their definitions, of texts by their lines. [I6, I8]"""
    code = parsed.select("path", F.explode("chunks").alias("c")).select("path", "c.*")
    return code.unionByName(packing.text_chunks(parsed.filter("content IS NOT NULL")))
