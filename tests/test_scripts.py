"""Scripts whose strings, comments, templates and regular expressions go over lines."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quillstone.operators import scripts

FILE = "path string, language string, content string"

WIDGET = r'''
import { fetchAll } from "./net";
/* class Ghost {
   from before: it { has
   braces */
export class Table {
  /**
   * render() { not this
   */
  render(rows) {
    const text = `
      function fake() {
        { { ${rows.length}
    `;
    const odd = /[}{]"'`/g.test(text), half = rows.length / 2 / 1;
    return draw(text, "a } b // c", 'it\'s {');
  }
  // close() {
  close() { stop(this.render); }
}

export const total = (xs) => {
  return fetchAll(xs.map((x) => `${x} }`));
};

export type Row = { id: number };
'''


def found(spark, content, path="lib/ui/widget.ts"):
    return spark.createDataFrame([(path, "typescript", content)], FILE)


def test_definitions_in_code_alone_and_their_ends(spark):
    got = {r["qualified_name"]: (r["kind"], r["start_line"], r["end_line"]) for r in scripts.symbols(found(spark, WIDGET)).collect()}
    at = {line.strip()[:14]: n for n, line in enumerate(WIDGET.split("\n"), 1)}
    assert got == {
        "lib.ui.widget": ("module", 1, len(WIDGET.split("\n"))), "lib.ui.widget.Table": ("class", at["export class T"], at["close() { stop"] + 1), "lib.ui.widget.Table.render": ("method", at["render(rows) {"], at["return draw(te"] + 1),
        "lib.ui.widget.Table.close": ("method", at["close() { stop"], at["close() { stop"]), "lib.ui.widget.total": ("function", at["export const t"], at["return fetchAl"] + 1), "lib.ui.widget.Row": ("class", at["export type Ro"], at["export type Ro"]),
    }


def test_calls_and_imports(spark):
    got = {(r["source_qualified_name"].rpartition(".")[2], r["target_qualified_name"], r["kind"]) for r in scripts.edges(found(spark, WIDGET)).collect()}
    assert got >= {("widget", "./net", "imports"), ("render", "draw", "calls"), ("close", "stop", "calls"), ("total", "fetchAll", "calls"), ("total", "xs.map", "calls")}
    assert not {t for _, t, _ in got} & {"fake", "it", "Ghost", "close"}


@pytest.mark.parametrize(
    ("content", "code"),
    [
        ("a = 'x{' + \"y\\\"}\" + b", "a =   +   + b"), ("a /* { \n } */ b", "a  \n b"), ("x = `a\r\n${b}\\`` + c", "x =  \r\n + c"), ("a / b / c // d\ne", "a / b / c  \ne"),
        ("f(/[/\"]{2}/g, 1)", "f( , 1)"), ("return /'/.test(x)", "return  .test(x)"), ("open 'never\nnext {", "open  \nnext {"), ("/* never { ends", " "), ("", ""), (None, None), ("n = a[1] / 2; m = 'q'", "n = a[1] / 2; m =  "),
    ],
)
def test_code_of(spark, content, code):
    assert spark.createDataFrame([(content,)], "c string").select(scripts.code_of(F.col("c"))).first()[0] == code


def test_broken_files_keep_what_was_found_and_long_ones_take_little(spark):
    names = {r["name"] for r in scripts.symbols(found(spark, "export class Open {\n  run() {\n    go(`never closed")).collect()}
    assert names == {"Open", "run", "widget"}
    long = "/* " + "{ " * 500_000 + "*/\nfunction f() {}\n`" + "x\\`" * 100_000 + "`\n'" + "\\'" * 100_000 + "'\nfunction g() {}\n"
    began = time.perf_counter()
    assert {r["name"] for r in scripts.definitions(found(spark, long)).collect()} == {"f", "g"}
    assert time.perf_counter() - began < 60
