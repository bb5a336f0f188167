"""The live tail: late, repeated and reordered files, a handover from history and a restart in the middle."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
import pytest

from quillstone.streaming import tail

STEP = "run_id string, number long, kind string"


def steps(run, numbers):
    return [(run, n, f"{run}{n}") for n in numbers]


@pytest.fixture
def feed(spark, tmp_path):
    def put(rows, n=[0]):  # noqa: B006
        n[0] += 1
        spark.createDataFrame(rows, STEP).coalesce(1).write.parquet(str(tmp_path / "src" / f"{n[0]:03d}"))

    def run(history=None, **options):
        stream = spark.readStream.schema(STEP).option("recursiveFileLookup", "true").parquet(str(tmp_path / "src"))
        q = tail.follow(tail.live_tail(stream, history, **options), str(tmp_path / "out"), str(tmp_path / "check"))
        assert q.awaitTermination(150)
        return out()

    def out():
        got = {}
        for r in spark.read.parquet(str(tmp_path / "out")).collect():
            got.setdefault(r["run_id"], []).append((r["number"], r["kind"], r["gap"]))
        return {k: sorted(v) for k, v in got.items()}

    (tmp_path / "src").mkdir()
    return put, run


def clean(run, numbers):
    return [(n, f"{run}{n}", False) for n in numbers]


def test_history_late_repeated_and_reordered_steps_with_a_restart(spark, feed):
    put, run = feed
    history = spark.createDataFrame(steps("a", range(4)) + steps("b", range(2)), STEP)
    # The stream brings a part of the history again, repeats itself, and 6 comes before 5.
    put(steps("a", [2, 3, 4, 6]) + steps("b", [1, 2, 2]) + steps("c", [1]))
    assert run(history) == {"a": clean("a", [4]), "b": clean("b", [2])}
    # The query ended and starts from its checkpoint: 6 and c's 1 wait in its state.
    put(steps("a", [5, 4]) + steps("c", [0, 0, 3]))
    put(steps("b", [3]) + steps("a", [7, 6]))
    assert run(history) == {"a": clean("a", [4, 5, 6, 7]), "b": clean("b", [2, 3]), "c": clean("c", [0, 1])}
    put(steps("c", [2]))
    assert run(history)["c"] == clean("c", [0, 1, 2, 3])


def test_a_number_that_never_comes_is_passed_after_patience(spark, feed):
    put, run = feed
    put(steps("a", [0, 2, 3]))
    first = run(patience=timedelta(milliseconds=1))
    assert first["a"][0] == (0, "a0", False)
    put(steps("b", [0]))
    assert run(patience=timedelta(milliseconds=1)) == {"a": [(0, "a0", False), (2, "a2", True), (3, "a3", False)], "b": clean("b", [0])}
    # What is passed stays passed.
    put(steps("a", [1, 4]))
    assert run(patience=timedelta(milliseconds=1))["a"][-1] == (4, "a4", False)


def test_rows_without_a_run_or_number(spark, feed):
    put, run = feed
    put([(None, 0, "x"), ("a", None, "x"), ("a", 0, None)])
    assert run() == {"a": [(0, None, False)]}


class Held(dict):
    """A state variable that counts the messages it would send."""

    calls = 0

    def __getattr__(self, name):
        def call(*args):
            Held.calls += 1
            match name:
                case "containsKey" | "exists":
                    return (args[0] if args else ()) in self
                case "getValue" | "get":
                    return super(Held, self).get(args[0] if args else ())
                case "updateValue":
                    self[args[0]] = args[1]
                case "removeKey":
                    del self[args[0]]
                case "iterator":
                    return iter(list(self.items()))

        return call

    def get(self, *key):
        return self.__getattr__("get")(*key)

    def update(self, value):
        self.__getattr__("updateValue")((), value)

    def keys(self):
        Held.calls += 1
        return iter(list(super().keys()))


class Handle:
    def __init__(self):
        self.timers = set()
        self.listTimers, self.deleteTimer, self.registerTimer = lambda: iter(list(self.timers)), self.timers.discard, self.timers.add
        self.getValueState = self.getMapState = lambda *_: Held()


def batches(run, *batches_):
    """Each batch is a list of parts of numbers; what comes out of each, and the messages to the state."""
    handle = Handle()
    run.init(handle)
    Held.calls, got = 0, []
    now = type("Now", (), {"getCurrentProcessingTimeInMs": lambda _: 5})()
    for parts in batches_:
        rows = (pd.DataFrame({"number": p, "value": [f"{k}:{n}" for n in p]}) for k, p in enumerate(parts))
        got.append([r for df in run.handleInputRows(("a",), rows, now) for r in zip(df["number"].tolist(), df["value"].tolist(), strict=True)])
    return got, Held.calls, handle


def test_steps_that_come_in_one_batch_send_few_messages():
    """20 000 steps of a run in any order; each used to send five messages."""
    numbers = [n * 7919 % 20_000 for n in range(20_000)]
    got, calls, handle = batches(tail.Tail(0, 10, 10), [numbers[:9000], numbers[9000:]])
    assert [n for n, _ in got[0]] == list(range(20_000)) and calls < 20 and not handle.timers


def test_waiting_steps_go_through_the_state_in_blocks(monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 4, raising=False)
    monkeypatch.setattr(tail, "MOST", 10, raising=False)
    late = [n for n in range(100) if n % 9 != 5]
    # The first of equal numbers counts, whether it waits in the task or in the state.
    got, _, handle = batches(tail.Tail(0, 10, 10), [late[::-1], late], [[5, 14, 98]], [list(range(100))], [[3, 99]])
    first = {n: v for rows in got for n, v in rows}
    assert [n for rows in got for n, _ in rows] == list(range(100)) and got[3] == []
    assert [n for n, _ in got[0]] == list(range(5)) and got[1][-1] == (22, "0:22")
    assert all(first[n] == f"0:{n}" for n in range(100)) and not handle.timers
