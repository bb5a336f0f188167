"""Strings that repeat inside one text."""

from __future__ import annotations

import tracemalloc

import numpy as np

from quillstone.llm import substring_dedup as dedup


def test_repeats_in_a_text_are_told_in_little_memory():
    """A text that repeats itself has a first place for every string; runs of them are compared once."""
    rng = np.random.default_rng(3)
    data = np.tile(rng.integers(97, 123, 700, dtype=np.uint8), 60)
    s = np.arange(len(data) - 399)
    h = dedup.Rolling(data, dedup.BASES[0]).at(s, 400)
    tracemalloc.start()
    again, first = dedup.kinds_of(data, s, 400, h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert again.all() and np.flatnonzero(first).tolist() == list(range(700))
    assert peak < 16 << 20, peak


def test_strings_with_one_hash_are_told_by_bytes():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    s = np.arange(7)
    again, first = dedup.kinds_of(data, s, 3, np.zeros(7, np.uint64))
    assert again.tolist() == [True] * 6 + [False]
    assert np.flatnonzero(first).tolist() == [0, 1, 2, 6]
