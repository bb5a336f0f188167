"""Lexical and vector search, and their fusion."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T

RRF_K = 60
CANDIDATES = 50
LITERAL_WEIGHTS, PROSE_WEIGHTS = (1.0, 0.6), (0.6, 1.0)
LEAST_SUBSTRING = 5
JAVA_QUOTE = ("\\Q", "\\E")


def lexemes(text: Column) -> Column:
    """Lower-cased runs of letters, digits and ``_/.-``, and the parts of compound runs. [R3]"""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_/.-]+"), F.lit(0))
    parts = lambda r: F.filter(F.regexp_extract_all(r, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda p: p != r)
    # Most runs are plain words: only compounds are taken apart.
    plain = lambda r: F.translate(r, "_/.-", "") == r
    return F.flatten(F.transform(runs, lambda r: F.when(plain(r), F.array(r)).otherwise(F.concat(F.array(r), parts(r)))))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, pos): store it bucketed by term to search without a full pass. [R3]"""
    return docs.select(id_col, F.posexplode(lexemes(F.col(text_col))).alias("pos", "term"))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, positions): how often each document holds each lexeme. [R3]"""
    return docs.select(id_col, F.explode(lexemes(F.col(text_col))).alias("term")).groupBy("term", id_col).agg(F.count("*").alias("positions"))


def positions(low: Column, terms: list[str]) -> Column:
    """Positions of the asked terms among the lexemes of a lower-cased text, counted without making the lexemes.

    A term of letters and digits is a lexeme wherever it is bounded by other characters, alone or in a compound; a
    compound one where nothing of a compound goes on.
    """
    total = F.lit(0)
    for term in dict.fromkeys(t.lower() for t in terms):
        around = r"\p{L}\p{N}" if re.fullmatch(r"[^\W_]+", term) else r"\p{L}\p{N}_/.-"
        counted = F.regexp_count(low, F.lit(rf"(?<![{around}]){JAVA_QUOTE[0]}{term}{JAVA_QUOTE[1]}(?![{around}])"))
        total = total + F.when(F.contains(low, F.lit(term)), counted).otherwise(0)
    return total


def cover_rank(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """(id, score): a tenth for every position of an asked term; documents without one are left out. [R7, R8]"""
    return docs.select(id_col, F.round(positions(F.lower(text_col), terms) * F.lit(0.1), 6).alias("score")).filter("score > 0")


def store_postings(docs: DataFrame, id_col: str, text_col: str, table: str, buckets: int = 64) -> None:
    """Postings as a table bucketed and sorted by term, so that a search reads the buckets and row groups of its terms alone. [R3]"""
    term_counts(docs, id_col, text_col).write.bucketBy(buckets, "term").sortBy("term").mode("overwrite").saveAsTable(table)


def rank_postings(stored: DataFrame, id_col: str, terms: list[str]) -> DataFrame:
    """cover_rank over stored postings(term, id, positions): the filter on terms reaches the scan. [R7, R8]"""
    asked = stored.filter(F.col("term").isin(*{t.lower() for t in terms}))
    return asked.groupBy(id_col).agg(F.round(F.sum("positions") * F.lit(0.1), 6).alias("score"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """[T1-T3, T12, T19]"""
    return df.orderBy(*order).limit(k)


def by_staged_terms(docs: DataFrame, id_col: str, text_col: str, stages: list[list[str]], substring: str | None, split: list[str], k: int | None) -> DataFrame:
    """(id, stage, score): the first stage with any hit wins: exact stages, then a substring, then split identifiers; all its hits
    without a k. [R6, R12]

    All stages are judged in one pass; the least stage of the corpus is kept by a one-row aggregate.
    """
    plan: list[tuple[Column, Column]] = []
    seen: set[frozenset[str]] = set()

    def terms_stage(terms: list[str]) -> None:
        if terms and frozenset(terms) not in seen:
            seen.add(frozenset(terms))
            n = positions(F.col("_low"), terms)
            plan.append((n > 0, F.round(n * F.lit(0.1), 6)))

    for terms in stages:
        terms_stage(terms)
    if substring and len(substring) >= LEAST_SUBSTRING:
        plan.append((F.contains(F.col("_low"), F.lit(substring.lower())), F.lit(0.0)))
    terms_stage(split)
    if not plan:
        return docs.select(id_col, F.lit(0).alias("stage"), F.lit(0.0).alias("score")).limit(0)
    held = docs.select(id_col, F.length(text_col).alias("_len"), F.lower(text_col).alias("_low"))
    scored = [F.when(test, F.struct(F.lit(i).alias("stage"), score.alias("score"))) for i, (test, score) in enumerate(plan)]
    # A document may hit several stages, and which one counts is known only over all documents.
    rows = held.select(id_col, "_len", F.explode(F.array_compact(F.array(*scored))).alias("x")).select(id_col, "_len", "x.*")
    first = rows.agg(F.min("stage").alias("_first"))
    kept = rows.join(F.broadcast(first), F.col("stage") == F.col("_first"))
    if k is not None:
        kept = kept.orderBy(F.desc("score"), F.when(F.col("score") == 0, F.col("_len")), id_col).limit(k)
    return kept.select(id_col, "stage", "score")


def query_stages(query: str) -> tuple[list[list[str]], str | None, list[str]]:
    """Exact stages, substring and split terms of one query string; a few words, handled on the driver. [R6]"""
    raw = [t.translate(str.maketrans("", "", "'\"\\")).strip("()[]{},;:!?<>=+*&|~`@#$%^ .-") for t in re.split(r"[^\w/.\-]+", query)]
    raw = [t for t in raw if any(c.isalnum() for c in t)]

    def longest(terms: list[str]) -> list[str]:
        own = list(dict.fromkeys(terms))
        long = [t for t in own if len(t) >= 3] or own
        return sorted(long, key=lambda t: (-len(t), t))[: T.MOST_TERMS]

    written = longest(raw)
    code = [t for t in written if re.search(r"[_/.]|\d", t) or (t != t.lower() and t != t.upper())]
    sizable = [t for t in code if len(t) >= LEAST_SUBSTRING]
    exact = ([[max(sizable, key=len)]] if len(sizable) >= 2 else []) + [code, written]
    pieces = [w.lower() for t in raw for c in t.split("_") for w in re.split(T.CAMEL, c) if len(w) > 1 and w.lower() != t.lower()]
    return [s for s in exact if s], max(sizable, key=len, default=None), longest(raw + pieces) if pieces else []


# --- vectors -----------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector or vectors of different lengths."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def vector_search(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str, model_col: str | None = None, model=None) -> DataFrame:
    """(id, score): the k nearest of a model's vectors by cosine; an empty query or unknown model finds nothing. [R10, T3]"""
    if not query:
        return vectors.select(id_col, F.lit(0.0).alias("score")).limit(0)
    rows = vectors if model_col is None else vectors.filter(F.col(model_col) == F.lit(model))
    asked = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(id_col, F.round(cosine(F.col(vector_col), asked), 6).alias("score")).filter("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


def reciprocal_rank_fusion(sides: list[DataFrame], weights: list[float], id_col: str, k: int, candidates: int = CANDIDATES) -> DataFrame:
    """(id, score): sum of weight / (60 + rank) over ranked sides (id, score), of candidates rows each. [R11, U1, W2, T4]

    Each side has at most `candidates` rows when it is ranked, so the unpartitioned window is small.
    """
    ranked = []
    for place, (side, weight) in enumerate(zip(sides, weights, strict=True)):
        cut = side.orderBy(F.desc("score"), id_col).limit(candidates)
        rank = F.row_number().over(Window.orderBy(F.desc("score"), id_col))
        ranked.append(cut.select(id_col, (F.lit(weight) / (F.lit(RRF_K) + rank)).alias("_part"), (F.lit(place * candidates) + rank).alias("_seen")))
    fused = reduce(DataFrame.unionByName, ranked).groupBy(id_col).agg(F.sum("_part").alias("score"), F.min("_seen").alias("_seen"))
    return fused.orderBy(F.desc(F.round("score", 9)), "_seen").limit(k).select(id_col, F.round("score", 9).alias("score"))


def expanded_search(lists: list[DataFrame], id_col: str, k: int) -> DataFrame:
    """Ordered union of result lists without repeats, cut at k. Each list is (id, rank). [R30, U2]"""
    tagged = [x.select(id_col, F.lit(n).alias("_list"), F.col("rank").alias("_rank")) for n, x in enumerate(lists)]
    first = reduce(DataFrame.unionByName, tagged).groupBy(id_col).agg(F.min(F.struct("_list", "_rank")).alias("_at"))
    return first.orderBy("_at._list", "_at._rank", id_col).limit(k).select(id_col, F.col("_at._list").alias("list"))
