"""Conversation repair against a search from the end of each conversation."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quillstone.llm import conversation_repair as cr
from quillstone.llm import queries

ROWS = "conv_id long, turn long, role string, text string"
STEPS = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def repaired(conv):
    """conv: rows of one conversation. The contract's figures."""
    conv = sorted(conv, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in conv:
        core = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def least(i, state, inserts):
        found = []
        if i == len(conv) and state in "0a":
            found.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in STEPS:
                    cost, audit, lines = least(i, STEPS[state, role[0]], inserts + 1)
                    found.append((cost + 5, "I" + audit, (role + ":", *lines)))
        if i < len(conv):
            _, _, role, text = conv[i]
            cost, audit, lines = least(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                for to, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if (state, to[:1]) in STEPS:
                        cost, audit, lines = least(i + 1, STEPS[state, to[:1]], 0)
                        found.append((cost + more + price, letter + audit, (to + ":" + text, *lines)))
        return min(found) if found else (10**9, "", ())

    for i in range(len(conv), -1, -1):  # from the end, so that the search stays shallow
        for state in "0sua":
            least(i, state, 0)
    cost, audit, lines = least(0, "0", 0)
    turns = [t for _, t, _, _ in conv if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in conv]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def wanted(rows, of=damaged):
    by = {c: [] for c, *_ in rows}
    for r in of(rows):
        by[r[0]].append(r)
    return sorted(((c, *repaired(v)) for c, v in by.items()), key=str)


def found(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_query_matches_the_search(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_conversation_repair(spark, sf)) == wanted(rows)


def drawn(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut", "", " \n", "Yes. \t", "a.b", "Ünï "]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "User", "sys"]
    return [(c if c else None, rng.choice([None, *range(k + 2)]) if rng.random() < 0.2 else k, rng.choice(roles), rng.choice([*texts, None])) for c in range(conversations) for k in range(rng.randint(1, most))]


def test_drawn_conversations_with_every_fault(spark):
    rows = drawn(3, 150, 12)
    got = found(cr.repair(cr.damage(spark.createDataFrame(rows, ROWS).repartition(6)), spark.createDataFrame(rows, ROWS)))
    assert got == wanted(rows)


@pytest.mark.parametrize("fan", [2, 16])
def test_one_conversation_over_many_partitions(spark, monkeypatch, fan):
    """Three conversations, one with nine tenths of the rows: its runs lie in many partitions and are joined as a tree."""
    monkeypatch.setattr(cr, "FAN", fan)
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Ok.", f"text {t // 3}.", "cut", " "])) for c, n in ((1, 10), (2, 400), (3, 20)) for t in range(n)]
    df = spark.createDataFrame(rows, ROWS)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = cr.structure(df)
        assert runs.count() == 3
        assert found(cr.repair(df, df)) == wanted(rows, lambda x: x)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_products_are_associative_and_runs_equal_single_steps():
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 50):
        kinds = "".join(rng.choice(cr.KINDS) for _ in range(n))
        step = cr.IDENTITY
        for k in kinds:
            step = cr.product(step, cr.turn_matrix(k))
        assert cr.run_matrix(kinds) == step
        a, b, c = (cr.run_matrix("".join(rng.choice(cr.KINDS) for _ in range(5))) for _ in range(3))
        assert cr.product(cr.product(a, b), c) == cr.product(a, cr.product(b, c))


def test_a_long_run_is_reduced_on_the_way():
    run = cr.Run(1, 0)
    for i in range(20_000):
        run.add(i, "user" if i % 2 == 0 else "assistant", 1, "ua"[i % 2], False, False)
    assert cr.outcome(run.matrix()) == (0, "K" * 20_000) and len(run.done) < 8
    run.add(20_000, "user", 3_000_000, "u", False, False)
    assert cr.ended(run.matrix()) == {"cost": 6_000_000, "audit": "K" * 20_000 + "D" * 3_000_000}
    assert run.row["duplicate"] == 2_999_999 and run.row["n_turns"] == 20_001


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (2, 5, "user", "x" * 200_000 + "."), (2, -(1 << 63), "assistant", "."), (2, (1 << 63) - 1, "user", "a" + " " * 100_000 + "b"), (3, 1, "", "")]
    df = spark.createDataFrame(rows, ROWS)
    got = found(cr.repair(df.na.fill(" ", ["role", "text"]), df))
    want = wanted([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], lambda x: x)
    assert [(c, min(g, (1 << 63) - 1), *rest) for c, g, *rest in want] == got
    wide = df.select("*", *[F.lit("x").alias(n) for n in ("part", "audit", "cost", "h", "n", "kind", "late", "_c", "_kind", "_copy", "costs", "gaps", "_what", "blank")])
    assert len(found(cr.repair(cr.damage(wide), wide))) == 4
    # A conversation of which no row is left.
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.")], ROWS)
    assert found(cr.repair(cr.damage(one), one)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    none = spark.createDataFrame([], ROWS)
    assert found(cr.repair(cr.damage(none), none)) == []
