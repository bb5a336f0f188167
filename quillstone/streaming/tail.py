"""Live tail of runs joined to their history, with state per run. [X1, X2, X5]

The state of a run is the number of the step that comes next and the steps that came before their turn. A step with
its number is handed on with all that waited for it; one with a smaller number is a repeat and goes; a later one waits. What
the history holds is given as initial state, so the stream goes on where the history ends, without a gap or a repeat,
whatever part of it the stream brings again. If a number never comes, the steps that wait for it are handed on after
`patience`, marked by `gap`. State that was not touched for `forget` expires.

State is kept in RocksDB beside the query's checkpoint, so a restart goes on in the middle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: With timers of processing time there always is another batch to run: a query that has to end runs none without data.
ENDS = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}

#: Numbers of a run that wait in the state as one value.
BLOCK = 256
#: Steps of a run that wait in a task before they go to the state.
MOST = 50_000


@contextmanager
def settings(spark: SparkSession, held: dict[str, str]):
    """Queries started inside run under these settings."""
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Tail(StatefulProcessor):
    """One run's steps (run_id, number, value) in the order of their numbers.

    Each call to the state is a message to the JVM, so a step that comes in its turn touches none: what waits is held in the task,
    and what still waits at the end of a batch, or is more than MOST steps before, goes to the state in blocks of BLOCK numbers.
    """

    def __init__(self, first: int, patience_ms: int, forget_ms: int):
        self.first, self.patience_ms, self.forget_ms = first, patience_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "number long, waits boolean", self.forget_ms)
        self.held = handle.getMapState("held", "block long", "steps string", self.forget_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.next.update((int(initialState["next"].iloc[0]), False))

    def _block(self, block: int) -> dict[int, str]:
        held = self.held.getValue((block,)) if self.held.containsKey((block,)) else None
        return dict(json.loads(held[0])) if held else {}

    def _hold(self, steps: dict[int, dict[int, str]], more: bool) -> None:
        """Blocks into the state; more: it may hold some already. Of steps with one number the first one counts."""
        for block, of in steps.items():
            self.held.updateValue((block,), (json.dumps(list(({**of, **self._block(block)} if more else of).items())),))
        steps.clear()

    def _out(self, key, rows: list[tuple[int, str, bool]]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({"run_id": [key[0]] * len(rows), "number": [n for n, _, _ in rows], "value": [v for _, v, _ in rows], "gap": [g for _, _, g in rows]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, waited = self.next.get() or (self.first, False)
        stored = waited
        fresh: dict[int, dict[int, str]] = {}
        out: list[tuple[int, str, bool]] = []
        for part in rows:
            for n, value in zip(part["number"].tolist(), part["value"].tolist(), strict=True):
                if n >= at:
                    fresh.setdefault(n // BLOCK, {}).setdefault(n, value)
            while True:
                block = at // BLOCK
                have = self._block(block) if stored else {}
                all_ = {**fresh.get(block, {}), **have}
                begun = at
                while at // BLOCK == block and at in all_:
                    out.append((at, all_.pop(at), False))
                    at += 1
                if at == begun:
                    break
                if have:
                    self.held.removeKey((block,))
                fresh.pop(block, None)
                if all_:
                    fresh[block] = all_
                if len(out) >= MOST:
                    yield from self._out(key, out)
                    out = []
            if sum(map(len, fresh.values())) > MOST:
                self._hold(fresh, stored)
                stored = True
        waits = bool(fresh)
        self._hold(fresh, stored)
        waits = waits or (stored and next(iter(self.held.keys()), None) is not None)
        self.next.update((at, waits))
        if waited or waits:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if waits:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield from self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.next.get()
        at = state[0] if state else self.first
        for block in sorted(k[0] for k in self.held.keys()):
            out = []
            for n, value in sorted(self._block(block).items()):
                out.append((n, value, n != at))
                at = n + 1
            yield from self._out(key, out)
        self.held.clear()
        self.next.update((at, False))

    def close(self) -> None:
        pass


def encoded(steps: DataFrame, run_col: str, number_col: str) -> DataFrame:
    """Steps as (run_id, number, value), their other columns as JSON; null runs and numbers have no order and are left out."""
    rest = [c for c in steps.columns if c not in (run_col, number_col)]
    rows = steps.filter(F.col(run_col).isNotNull() & F.col(number_col).isNotNull())
    return rows.select(F.col(run_col).cast("string").alias("run_id"), F.col(number_col).cast("long").alias("number"), F.to_json(F.struct(*rest)).alias("value"))


def last_numbers(history: DataFrame, run_col: str = "run_id", number_col: str = "number") -> DataFrame:
    """(run_id, next): where each run's history ends."""
    return history.filter(F.col(run_col).isNotNull()).groupBy(F.col(run_col).cast("string").alias("run_id")).agg((F.max(number_col) + 1).cast("long").alias("next"))


def live_tail(
    stream: DataFrame, history: DataFrame | None = None, run_col: str = "run_id", number_col: str = "number", first: int = 0, patience: timedelta = timedelta(minutes=10), forget: timedelta = timedelta(days=1),
) -> DataFrame:
    """The stream's steps after the history's, in order of their numbers per run, each once, with a flag where numbers are missing before. Start it with follow(), or under the settings ROCKSDB."""
    ms = lambda t: int(t.total_seconds() * 1000)
    rest = StructType([f for f in stream.schema if f.name not in (run_col, number_col)])
    grouped = encoded(stream, run_col, number_col).groupBy("run_id")
    initial = last_numbers(history, run_col, number_col).groupBy("run_id") if history is not None else None
    out = grouped.transformWithStateInPandas(Tail(first, ms(patience), ms(forget)), "run_id string, number long, value string, gap boolean", "Append", "ProcessingTime", initial)
    return out.select(F.col("run_id").alias(run_col), F.col("number").alias(number_col), F.from_json("value", rest).alias("_v"), "gap").select(run_col, number_col, "_v.*", "gap")


def follow(tail: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append the tail to a folder; with available_now it ends when all that is there has been read."""
    with settings(tail.sparkSession, ROCKSDB | (ENDS if available_now else {})):
        writer = tail.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
