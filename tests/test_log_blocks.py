"""The tail of a log against a scan of all its lines, and how little of it is read."""

from __future__ import annotations

import json

import pytest

from quillstone.sources import log_blocks
from quillstone.sources.files import log_tail


def entry(i, level="info", text="x"):
    return json.dumps({"timestamp": str(i), "level": level, "logger": "app.a" if i % 2 else "lib", "event": f"{text} {i} é\U0001f600"}, ensure_ascii=False)


@pytest.mark.parametrize("block", [1, 7, 64, 1000, 1 << 20])
def test_lines_belong_to_the_block_in_which_they_begin(tmp_path, block):
    body = b"first\n\nthird line\r\n" + "ünï\n".encode() + b"x" * 200 + b"\nlast without end"
    file = tmp_path / "log"
    file.write_bytes(body)
    cuts = [*range(0, len(body), block), len(body)]
    got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in log_blocks.lines_of(log_blocks.Block(str(file), 100, a, b))]
    want, at = [], 100
    for line in body.split(b"\n"):
        want.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    assert got == want


def test_tail_equals_a_scan_and_reads_the_end_alone(spark, tmp_path):
    lines = [entry(i, "error" if i % 50 == 0 else "info") if i % 7 else "not json" for i in range(20_000)]
    for n in range(4):
        (tmp_path / f"app.log.{n}").write_text("\n".join(lines[n * 5000 : (n + 1) * 5000]) + "\n", encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("")
    scanned = spark.createDataFrame(list(enumerate(lines)), "number long, value string")
    for k, options in ((10, {}), (30, {"min_level": "error"}), (5, {"logger": "app"}), (3, {"words": "X 19"}), (5, {"words": "X 17"}), (1000, {"min_level": "error"}), (4, {"words": "nowhere"})):
        want = [r["value"] for r in log_tail(scanned, k, **options).collect()]
        got = log_blocks.tail(spark, str(tmp_path), k, block=16_384, **options)
        assert [r["value"] for r in got.rows.collect()] == want
        if k <= 30 and len(want) == k and not options.get("words"):
            assert got.bytes < got.of_bytes / 4
        if not want:
            assert got.bytes == got.of_bytes


def test_empty_logs(spark, tmp_path):
    assert log_blocks.tail(spark, str(tmp_path), 5).rows.count() == 0
    (tmp_path / "a.log").write_text("")
    got = log_blocks.tail(spark, str(tmp_path), 5)
    assert got.rows.count() == 0 and got.bytes == 0
