"""Repair of the role structure of conversations by a min-plus matrix scan.

A well-formed conversation has role initials s?(ua)+ or no row. States: start, after system,
after user, after assistant; start and after-assistant accept. Each turn is a 4x4 matrix over
(cost, audit): entry (p, q) is the cheapest way to take the turn, after any inserts, from state
p to q, and the edits' initials that it writes. The product takes the least cost and, among
equals, the least audit. That is associative, as two audits of equal cost over the same turns
never are one the other's beginning: the longer one would hold further inserts and so cost more.

Turns are reduced as a tree: halves of a run inside a task (runs of few kinds are remembered),
then the runs of one conversation that lie in several range partitions, FAN at a time. The
rows that this takes are counted groups of equal rows without their texts, globally sorted by
conversation and turn, so a conversation of any length is dealt to many tasks. The last step
deals texts and audits by conversation and hashes the repaired rows as they stream by; that
is one task per conversation, in bounded memory but for its audit, as SHA-256 is sequential.

Nulls: a null role or text counts as one space, null turns come first and take no part in
gaps, null conversation ids are one conversation. Turns that tie go by role, then by the SHA-256 of
their text; repeated rows are copies beside each other. An empty role, or one of another first
letter than s, u, a, cannot be kept. Texts are read whole. An empty table gives none; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import keep, partitions

#: White space: space and the characters from tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"

#: What edits cost; a row that ends without a stop costs TRUNCATED more unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: From state to state by an initial: start 0, after system 1, after user 2, after assistant 3.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
#: Runs of one conversation that are joined at a time, and runs of up to so many turns that are remembered.
FAN, REMEMBERED = 16, 24
#: A row's kind: its initial (capital if truncated), x for another initial, d for a row that has to go.
KINDS = "suaxSUAXd"
#: Rows of equal text and turn that are laid out at a time.
STRETCH = 1 << 20

Cell = tuple[int, str] | None
Matrix = tuple[Cell, ...]


def best(a: Cell, b: Cell) -> Cell:
    return b if a is None or (b is not None and b < a) else a


def product(left: Matrix, right: Matrix) -> Matrix:
    out: list[Cell] = [None] * 16
    for p in range(0, 16, 4):
        for k in range(4):
            if (a := left[p + k]) is None:
                continue
            for q in range(4):
                if (b := right[4 * k + q]) is not None:
                    out[p + q] = best(out[p + q], (a[0] + b[0], a[1] + b[1]))
    return tuple(out)


IDENTITY: Matrix = tuple((0, "") if i % 5 == 0 else None for i in range(16))


def _closure() -> Matrix:
    """Any number of inserts: of an empty user or assistant row."""
    one: list[Cell] = list(IDENTITY)
    for (p, letter), q in NEXT.items():
        if letter in ROLES:
            one[4 * p + q] = best(one[4 * p + q], (INSERT, "I"))
    out = tuple(one)
    for _ in range(2):
        out = product(out, out)
    return out


CLOSURE = _closure()


@lru_cache(None)
def turn_matrix(kind: str) -> Matrix:
    """Inserts and then the turn: kept, given another role, or deleted."""
    out: list[Cell] = [None] * 16
    for p in range(4):
        out[5 * p] = (DELETE, "D")
    if kind != "d":
        more = TRUNCATED if kind.isupper() else 0
        for (p, letter), q in NEXT.items():
            if letter == kind.lower():
                out[4 * p + q] = best(out[4 * p + q], (more, "K"))
            if letter in ROLES:
                out[4 * p + q] = best(out[4 * p + q], (more + REROLE, "R"))
    return product(CLOSURE, tuple(out))


def run_matrix(kinds: str) -> Matrix:
    """The product over a run of turns, by halves."""
    return _remembered(kinds) if len(kinds) <= REMEMBERED else product(run_matrix(kinds[: len(kinds) // 2]), run_matrix(kinds[len(kinds) // 2 :]))


@lru_cache(1 << 15)
def _remembered(kinds: str) -> Matrix:
    if len(kinds) < 2:
        return turn_matrix(kinds) if kinds else IDENTITY
    return product(_remembered(kinds[: len(kinds) // 2]), _remembered(kinds[len(kinds) // 2 :]))


def outcome(m: Matrix) -> tuple[int, str]:
    """Cheapest cost and its audit from the start to an accepting state, inserts at the end included."""
    end = product(m, CLOSURE)
    return min(end[q] for q in ACCEPT if end[q] is not None)


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by the remainder of their ids' CRC-32 by 20."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told(conv_col), F.lit(":"), told(turn_col)).cast("binary")) % 20
    marked = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    marked = marked.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "_kind")
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select("conv_id", "turn", "role", "text", copies.alias("_copy")).drop("_copy")


def _kind_of(role: Column, blank: Column, cut: Column) -> Column:
    initial = F.substring(role, 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(blank, F.lit("d")).when(cut, F.upper(known)).otherwise(known)


def distinct_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, n, kind, late): equal rows counted, without texts; late if role and text stand at an earlier turn too."""
    text = F.col("text")
    kept = F.rtrim(text, F.lit(WHITE))
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"), (kept == "").alias("blank"), (~F.right(kept, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    narrow = keep(narrow.groupBy("conv_id", "turn", "role", "h").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")), "turns")
    # Few texts come twice, so the side of the join that names the first of them is small; the other splits where it is skewed.
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    twice = narrow.filter("NOT blank").groupBy("conv_id", "role", "h").agg(F.min(order).alias("first"), F.count("*").alias("_m")).filter("_m > 1").drop("_m")
    twice = twice.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"), F.col("first"))
    joined = narrow.join(twice, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h")), "left")
    late = F.coalesce(order > F.col("first"), F.lit(False))
    return joined.select("conv_id", "turn", "role", "h", "n", _kind_of(F.col("role"), F.col("blank"), F.col("cut")).alias("kind"), F.col("blank"), late.alias("late"))


def stats_schema(conv_type: str, turn_type: str) -> str:
    """A run of turns: counts, its two ends, and either the outcome or, where the conversation may go on, the matrix of 16 costs (null: none) and audits."""
    return (
        f"conv_id {conv_type}, part long, first_turn {turn_type}, last_turn {turn_type}, n_turns long, blank long, duplicate long, truncated long, illegal long, "
        "first_role string, last_role string, cost long, audit string, costs array<long>, audits array<string>"
    )


LEGAL = {"su", "ua", "au"}


def joined(a: dict, b: dict) -> dict:
    """Two runs of one conversation, one after the other."""
    m = product(cells(a), cells(b))
    turns = [x for r in (a, b) for x in (r["first_turn"], r["last_turn"]) if x is not None]
    return {
        "conv_id": a["conv_id"], "part": a["part"], "first_turn": min(turns, default=None), "last_turn": max(turns, default=None),
        "n_turns": a["n_turns"] + b["n_turns"] - (a["last_turn"] is not None and a["last_turn"] == b["first_turn"]),
        **{c: a[c] + b[c] for c in ("blank", "duplicate", "truncated")},
        "illegal": a["illegal"] + b["illegal"] + (a["last_role"] + b["first_role"] not in LEGAL),
        "first_role": a["first_role"], "last_role": b["last_role"], **spread(m),
    }


def cells(run: dict) -> Matrix:
    return tuple(None if c is None else (c, t) for c, t in zip(run["costs"], run["audits"], strict=True))


def ended(m: Matrix) -> dict:
    return dict(zip(("cost", "audit"), outcome(m), strict=True))


def spread(m: Matrix) -> dict:
    return {"costs": [None if c is None else c[0] for c in m], "audits": [None if c is None else c[1] for c in m]}


class Run:
    """A conversation's turns as a task meets them, in order; long ones are reduced on the way."""

    def __init__(self, conv, part: int):
        self.row = {"conv_id": conv, "part": part, "first_turn": None, "last_turn": None, "n_turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first_role": None, "last_role": None}
        self.kinds: list[str] = []
        self.length = 0
        self.done: list[tuple[int, Matrix]] = []

    def add(self, turn, role: str, n: int, kind: str, blank: bool, late: bool) -> None:
        row, initial = self.row, role[:1]
        if turn is not None and turn != row["last_turn"]:
            row["n_turns"] += 1
            row["first_turn"] = turn if row["first_turn"] is None else row["first_turn"]
            row["last_turn"] = turn
        if row["last_role"] is None:
            row["first_role"] = initial
        elif row["last_role"] + initial not in LEGAL:
            row["illegal"] += 1
        row["illegal"] += n - 1
        row["last_role"] = initial
        if blank:
            row["blank"] += n
        else:
            row["duplicate"] += n - (not late)
            row["truncated"] += not late and kind.isupper()
        first = kind if not late else "d"
        self.put(first)
        for a in range(1, n, STRETCH):
            self.put("d" * min(STRETCH, n - a))

    def put(self, kinds: str) -> None:
        self.kinds.append(kinds)
        self.length += len(kinds)
        if self.length >= 4096:
            self.reduce()

    def reduce(self) -> None:
        """Runs are joined as in a binary counter: equal lengths with each other."""
        if self.length:
            m, n = run_matrix("".join(self.kinds)), self.length
            while self.done and self.done[-1][0] <= n:
                before, left = self.done.pop()
                m, n = product(left, m), n + before
            self.done.append((n, m))
            self.kinds, self.length = [], 0

    def matrix(self) -> Matrix:
        self.reduce()
        out = IDENTITY
        for _, m in reversed(self.done):
            out = product(m, out)
        return out


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _runs(schema: pa.Schema):
    """Sorted turns -> one run per conversation and partition; a partition's first and last conversation may go on elsewhere and keep their matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now: Run | None = None
        first = True
        out: list[dict] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "kind", "blank", "late")]
            for conv, *rest in zip(*columns, strict=True):
                if now is None or conv != now.row["conv_id"]:
                    if now is not None:
                        m = now.matrix()
                        out.append(now.row | (spread(m) if first else ended(m)))
                        first = False
                    now = Run(conv, part)
                now.add(*rest)
                if len(out) >= 2000:
                    yield _table(out, schema)
                    out = []
        if now is not None:
            out.append(now.row | spread(now.matrix()))
        if out:
            yield _table(out, schema)

    return run


def _folded(schema: pa.Schema, fan: int):
    """Runs sorted by conversation and part -> one run per conversation and fan of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            for row in batch.to_pylist():
                row["part"] //= fan
                if held is not None and held["conv_id"] == row["conv_id"] and held["part"] == row["part"]:
                    held = joined(held, row)
                    continue
                if held is not None:
                    yield _table([held], schema)
                held = row
        if held is not None:
            yield _table([held], schema)

    return run


def structure(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> one run of turns per conversation, as stats_schema."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = stats_schema(types["conv_id"], types["turn"])
    schema = _arrow(rows, ddl)
    turns = keep(distinct_turns(rows), "ordered")
    runs = turns.orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "h").mapInArrow(_runs(schema), ddl)
    runs = keep(runs, "runs")
    open_ = runs.filter("costs IS NOT NULL")
    parts = (open_.agg(F.max("part").alias("m")).first()["m"] or 0) + 1
    while parts > 1:
        near = open_.repartition(partitions(rows.sparkSession), "conv_id", F.floor(F.col("part") / FAN)).sortWithinPartitions(F.asc_nulls_first("conv_id"), "part")
        open_ = keep(near.mapInArrow(_folded(schema, FAN), ddl), "folded")
        parts = -(-parts // FAN)
    return runs.filter("costs IS NULL").unionByName(open_.mapInArrow(_finished(schema), ddl))


def _finished(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([row | {"costs": None, "audits": None} | ended(cells(row)) for row in batch.to_pylist()], schema)

    return run


def _repaired(schema: pa.Schema):
    """Per conversation first its audit, then its rows in order -> the hash of its repaired rows, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, digest, first = None, None, 0, 0, None, True
        ids: list = []
        hashes: list[str] = []

        def write(role: str, text: str) -> None:
            nonlocal first, state
            digest.update((("" if first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
            first, state = False, NEXT[state, role[0]]

        def fresh() -> str:
            """The role that a row of any role takes here."""
            return "assistant" if state == 2 else "user"

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                write(fresh(), "")
                at += 1

        def end() -> None:
            inserts()
            ids.append(conv)
            hashes.append(digest.hexdigest())

        for batch in batches:
            for c, edits, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "role", "text")), strict=True):
                if edits is not None:
                    if digest is not None:
                        end()
                    conv, audit, at, state, digest, first = c, edits, 0, 0, hashlib.sha256(), True
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "K":
                    write(role, text)
                elif edit == "R":
                    write(fresh(), text)
            if len(ids) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field("conv_id").type), pa.array(hashes, pa.string())], schema=schema)
                ids, hashes = [], []
        if digest is not None:
            end()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field("conv_id").type), pa.array(hashes, pa.string())], schema=schema)

    return run


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows(conv_id, turn, role, text) under audits(conv_id, audit)."""
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    ddl = f"conv_id {conv}, repaired_sha256 string"
    none = lambda kind: F.lit(None).cast(kind)
    texts = rows.select("conv_id", F.lit(1).alias("_what"), "turn", "role", "text", none("string").alias("audit"))
    heads = audits.select("conv_id", F.lit(0).alias("_what"), none(turn).alias("turn"), none("string").alias("role"), none("string").alias("text"), "audit")
    both = heads.unionByName(texts).repartition(partitions(rows.sparkSession), "conv_id").withColumn("_h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    ordered = both.sortWithinPartitions(F.asc_nulls_first("conv_id"), "_what", F.asc_nulls_first("turn"), "role", "_h")
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(_repaired(_arrow(rows, ddl)), ddl)


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of conversations: its faults in rows(conv_id, turn, role, text), the cheapest repair and the repaired rows' hash."""
    found = structure(rows)
    # Turns at both ends of the range of longs leave more gaps than a long holds.
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.least(F.coalesce(wide("last_turn") - wide("first_turn") + 1 - wide("n_turns"), F.lit(0).cast("decimal(20,0)")), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")
    found = keep(found.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "audits")
    hashes = repaired_hashes(rows, found.select("conv_id", "audit"))
    every = conversations.select("conv_id").distinct().select(F.col("conv_id").alias("_every"))
    done = found.join(hashes.select(F.col("conv_id").alias("_c"), "repaired_sha256"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    out = every.join(done, F.col("_every").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        F.col("_every").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
