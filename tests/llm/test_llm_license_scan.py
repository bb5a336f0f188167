"""License scan against searches over every place of small texts."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillstone.llm import license_scan, queries

SCAN = license_scan.scanner(license_scan.NOTICES, license_scan.BASE)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = re.findall(WORD, (text or "").translate(LOW))
    places, labels = [], set()
    for label, phrase in license_scan.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def ends(norm, notice, start):
    """Ends of all texts from start that the notice allows, by dynamic programming over each stretch."""
    now = {start}
    for exact, part in re.findall(r"\[([^\]]+)\]|([^\[\]]+)", notice):
        part = f" {exact} " if exact else part.strip(" ")
        k = 0 if exact else min(license_scan.MOST, len(part) // license_scan.EACH)
        after = set()
        for a in now:
            row = list(range(len(part) + 1))
            for b in range(a, min(len(norm), a + len(part) + k) + 1):
                if row[-1] <= k:
                    after.add(b)
                if b < len(norm):
                    new = [row[0] + 1]
                    for j, c in enumerate(part):
                        new.append(min(row[j] + (c != norm[b]), row[j + 1] + 1, new[j] + 1))
                    row = new
                if min(row) > k:
                    break
        now = after
    return now


def brute_labels(text):
    words = re.findall(WORD, (text or "").translate(LOW))
    norm = f" {' '.join(words)} " if words else ""
    out = set(base(text)[4].split(",")) - {""}
    for label, notice in license_scan.NOTICES:
        if label not in out and any(ends(norm, notice, a) for a in range(len(norm))):
            out.add(label)
    return ",".join(sorted(out))


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text) + 1)
        text = text[:i] + rng.choice(["", "x", "e", " ", text[i : i + 1] * 2]) + text[i + rng.choice([0, 1]) :]
    return text


def test_labels_match_a_search_over_every_place():
    rng = random.Random(6)
    filler = "the of license and under version public rights copy mit gnu cc by".split()
    hits = 0
    for n in range(120):
        notice = rng.choice(license_scan.NOTICES)[1].replace("[", "").replace("]", "")
        text = " ".join(rng.choices(filler, k=rng.randint(0, 8))) + " " + edited(rng, notice, n % 6) + ", " + " ".join(rng.choices(filler, k=rng.randint(0, 5)))
        got = SCAN.scan(text)
        assert got["labels"] == brute_labels(text), text
        hits += bool(got["labels"])
        for s in got["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(text)
    assert 50 < hits < 120


def test_seeds_of_pigeonhole():
    for n in SCAN.notices:
        pieces = n.pieces()
        assert len(pieces) == n.edits + 1 and "".join(p for _, p in pieces) == n.text and min(len(p) for _, p in pieces) >= 4


def test_spans_are_of_the_text_as_it_is():
    text = "Ünï -- Released  UNDER\nthe **MIT** licence!! (cc BY-nc 4.0) and GNU General Public License, version 3."
    got = SCAN.scan(text)
    assert [(s["label"], text[s["start"] : s["end"]], s["edits"]) for s in got["spans"]] == [("mit", "UNDER\nthe **MIT** licence", 1), ("cc-by-nc", "cc BY-nc", 0), ("gpl-3", "GNU General Public License, version 3", 0)]
    assert got["labels"] == "cc-by-nc,gpl-3,mit" and got["base_labels"] == "cc-by-nc" and got["score"] == 1.0
    assert SCAN.scan("apache license version 1")["labels"] == "" and 0.9 < SCAN.scan("aapche license version 2")["score"] < 1
    assert SCAN.scan("under the mpl license, under the isc license")["labels"] == ""


def test_overlapping_places_count_and_share_their_space():
    got = SCAN.scan("CC BY-NC cc by nc cc-by-nc")
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (9, 3, 0, 6)


def test_query_matches_the_search(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_license_scan(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        t = docs[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t)
        if len(t or "") < (2000 if r["labels"] else 300):
            assert r["labels"] == brute_labels(t)
        assert (r["score"] > 0) == bool(r["labels"])
    assert any(r["labels"] for r in rows)


@pytest.mark.parametrize("unit", ["under the mit license ", "under the mit licens ", "license ", "general public ", "x"])
def test_long_texts_take_time_in_proportion(unit):
    began = time.process_time()
    SCAN.scan(unit * 20_000)
    assert time.process_time() - began < 30


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, " .\n"), (2, " .\n"), (3, "under the mit license " * 3000), (None, "cc by nc"), (4, "Ünder é\U0001f600 cc by nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:6] for r in license_scan.scan(df).collect()), key=str)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=str)
    wide = df.select("*", *[F.lit("x").alias(c) for c in ("labels", "score", "spans", "n_words", "base_labels")])
    assert sorted((tuple(r)[:6] for r in license_scan.scan(wide).collect()), key=str) == got
    assert license_scan.scan(df.limit(0)).count() == 0
