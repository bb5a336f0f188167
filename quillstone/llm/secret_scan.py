"""Secret scans over a trigram inverted index.

For every rule a Boolean trigram query is derived from its regex: strings that any match
must contain give an OR of ANDs of trigrams (lower-cased). Postings (trigram, document)
are built for the trigrams that the queries use, intersected per alternative by counting,
and the candidates alone are verified with the regex. A rule without mandatory trigrams
(such as a run of hexadecimal digits) scans every text.

Postings name a row by a hash of its id and text, so rows with null or repeated ids spread;
rows that share a hash are candidates together, which the regex decides.

Positions are code points, end exclusive: the pieces between matches (split) and the
matches (extract) are laid end to end. Null text is empty; texts are scanned whole, of any
length; repeated rows are scanned each; spans that start alike stand in the order of the
rules; an empty table gives an empty result. A column _spans of docs is replaced; all
others stay, whatever their names but for _quill_*.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import ascii_lower


@dataclass(frozen=True)
class Rule:
    """regex in the common syntax of Java and Python; only matches whose group has min_len characters or more count."""

    kind: str
    regex: str
    min_len: int = 1
    group: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.regex


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
EXTRA = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
)
RULES = BASE + EXTRA
MOST_STRINGS = 64


def _strings(node) -> set[str] | None:
    """All strings that a parsed node can match, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        if all(str(x[0]) == "LITERAL" for x in arg) and len(arg) <= 8:
            return {chr(x[1]).lower() for x in arg}
        return None
    if op == "SUBPATTERN":
        return _sequence(arg[-1])
    if op == "BRANCH":
        found = [_sequence(x) for x in arg[1]]
        return None if None in found else set().union(*found)
    if op == "MAX_REPEAT" and arg[1] == 1:
        inner = _sequence(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _strings(node)
        if found is None or len(out) * len(found) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, found)}
    return out


def trigram_query(regex: str) -> list[frozenset[str]]:
    """OR of ANDs: a match contains all trigrams of one set. Empty: no trigram is mandatory."""
    best: list[frozenset[str]] = []
    runs, at = [], {""}
    for node in sre.parse(regex):
        found = _strings(node)
        if found is None or len(at) * len(found) > MOST_STRINGS:
            runs.append(at)
            at = {""} if found is None else found
        else:
            at = {a + b for a, b in product(at, found)}
    for run in [*runs, at]:
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if not all(sets):
            continue
        least = {s for s in sets if not any(t < s for t in sets)}
        weight = lambda alternatives: (min(map(len, alternatives), default=0), -len(alternatives))
        if weight(least) > weight(best):
            best = sorted(least, key=sorted)
    return best


def queries_of(rules=RULES) -> dict[str, list[frozenset[str]]]:
    return {r.kind: trigram_query(r.regex) for r in rules}


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """The inverted index over the given trigrams: (trigram, _key)."""
    low = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in vocabulary]))
    return docs.select(row_key(id_col, text_col).alias("_key"), low.alias("_low")).select("_key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Intersected postings: (_key, _kinds), one row per row key that satisfies some query, with the kinds to verify."""
    queries = {k: q for k, q in queries_of(rules).items() if q}
    rows = [(kind, n, len(grams), t) for kind, q in queries.items() for n, grams in enumerate(q) for t in sorted(grams)]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(rows, "kind string, alternative int, need int, trigram string")
    index = postings(docs, id_col, text_col, sorted({r[3] for r in rows}))
    # The rules are literals of this module: a few dozen rows are broadcast.
    met = index.join(F.broadcast(wanted), "trigram").groupBy("_key", "kind", "alternative", "need").agg(F.count_distinct("trigram").alias("_n"))
    return met.filter("_n >= need").groupBy("_key").agg(F.collect_set("kind").alias("_kinds"))


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Array of (start, place, end) of the rule's matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group))
    pieces = F.arrays_zip(F.split(text, rule.java).alias("gap"), whole.alias("hit"), judged.alias("part"))
    span = "array<struct<start:int,place:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        new = F.array(F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"))).cast(span)
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.min_len, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """docs with _spans: array of (start, place in rules, end), sorted."""
    docs = docs.drop("_spans")
    found = candidates(docs, id_col, text_col, rules).select(F.col("_key").alias("_quill_key"), F.col("_kinds").alias("_quill_kinds"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("_quill_key", row_key(id_col, text_col)).join(found, "_quill_key", "left").drop("_quill_key")
    none = F.array().cast("array<struct<start:int,place:int,end:int>>")
    queries = queries_of(rules)
    parts = []
    for place, rule in enumerate(rules):
        asked = F.array_contains("_quill_kinds", rule.kind) if queries[rule.kind] else text.rlike(rule.java)
        parts.append(F.when(asked, spans_of(text, rule, place)).otherwise(none))
    return rows.withColumn("_spans", F.array_sort(F.concat(*parts))).drop("_quill_kinds")


def written(spans: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["place"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in their texts replaced, longest spans first where they overlap."""
    rows = scan(docs, id_col, text_col, rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.size("_spans") > 0, clean).otherwise(F.col(text_col))).select(docs.columns)
