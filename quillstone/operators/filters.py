"""Filters and predicates over files, symbols and tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(files: DataFrame, repository_id=None) -> DataFrame:
    """Files that are not deleted, of one repository if named. [P1]"""
    out = files.filter(~F.col("is_deleted"))
    return out if repository_id is None else out.filter(F.col("repository_id") == F.lit(repository_id))


def of_languages(df: DataFrame, languages=(), column: str = "language") -> DataFrame:
    """No language named means no filter. [P2, R25]"""
    return df.filter(F.col(column).isin(*languages)) if languages else df


def path_matches(path: Column, pattern: str, literal: bool = False) -> Column:
    """``*`` is any text; a leading dot asks for a suffix; else the whole path or its end after a slash.

    Unless literal, underscore and percent in the pattern match as in LIKE. A blank
    pattern, or one of slashes, matches nothing. [P3, P4]
    """
    pattern = pattern.strip().lstrip("/")
    if not pattern:
        return F.lit(False)
    if literal:
        escape = lambda s: s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    else:
        escape = lambda s: s
    if "*" in pattern:
        return path.like("%".join(escape(p) for p in pattern.split("*")))
    if pattern.startswith("."):
        return path.like("%" + escape(pattern))
    return (path == pattern) | path.like("%/" + escape(pattern))


def git_path_matches(path: Column, pattern: str) -> Column:
    """The wider match of a working tree: glob, suffix, else equal, suffix or substring. [P24]"""
    if "*" in pattern:
        return path.rlike(glob_regex(pattern if "/" in pattern else "*" + pattern))
    if pattern.startswith("."):
        return path.endswith(pattern)
    return (path == pattern) | path.endswith("/" + pattern) | F.contains(path, F.lit(pattern))


def name_matches(qualified: Column, name: str, literal: bool = False) -> Column:
    """The whole qualified name or its end after a dot. [P5]"""
    end = qualified.endswith("." + name) if literal else qualified.like("%." + name)
    return (qualified == name) | end


def contains_ignoring_case(text: Column, needle: str) -> Column:
    """[P6]"""
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


def overlaps(start: Column, end: Column, first: Column, last: Column) -> Column:
    """[P7]"""
    return (start <= last) & (end >= first)


def glob_regex(pattern: str) -> str:
    """Anchored regex of a shell pattern in which ``*`` crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append("\\" + c if not c.isalnum() and c != "_" and ord(c) < 128 else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def include_paths(df: DataFrame, patterns=(), column: str = "path") -> DataFrame:
    """Rows whose path some pattern matches; no pattern keeps all. [P10]"""
    return df.filter(F.col(column).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))) if patterns else df


def scoped_to_tenant(root: DataFrame, tenant: str | None, *chain: tuple[DataFrame, str, str], column: str = "tenant_id") -> list[DataFrame]:
    """Rows of one tenant down a chain of tables: (child, its key, the parent's key). No tenant, no rows. [P21]"""
    top = root.filter(F.col(column) == F.lit(tenant)) if tenant is not None else root.filter(F.lit(False))
    out = [top]
    for child, key, parent_key in chain:
        parents = out[-1].select(F.col(parent_key).alias("_parent")).distinct()
        out.append(child.join(parents, child[key] == F.col("_parent"), "left_semi"))
    return out


def usable_snapshots(snapshots: DataFrame, head_sha: str) -> DataFrame:
    """[P23]"""
    return snapshots.filter((F.col("commit_sha") == head_sha) & (F.col("status") == "ready"))


def in_states(df: DataFrame, states, column: str = "status") -> DataFrame:
    """[P20]"""
    return df.filter(F.col(column).isin(*states))


def point_lookup(df: DataFrame, **keys) -> DataFrame:
    """Row of a unique key. [S15, S26]"""
    for column, value in keys.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def edges_of(edges: DataFrame, symbol_id, incoming: bool) -> DataFrame:
    """[J24]"""
    return edges.filter(F.col("target_symbol_id" if incoming else "source_symbol_id") == F.lit(symbol_id))
