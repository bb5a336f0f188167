"""Searches with a deadline: only the late search's jobs are cut, other queries of the session go on. [R9]"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

#: Seconds that a search may take unless told otherwise.
SECONDS = 5.0
Result = TypeVar("Result")


class DeadlineExceeded(TimeoutError):  # noqa: N818
    """A search took longer than it may."""

    def __init__(self, seconds: float):
        super().__init__(f"the search took more than {seconds:g} seconds")
        self.seconds = seconds


def within(spark: SparkSession, seconds: float | None, run: Callable[[], Result]) -> Result:
    """What run returns, if its jobs end in time; else they are cut and DeadlineExceeded is raised. None or less: no deadline.

    The jobs that run starts in this thread carry a tag of their own, which a timer cancels; the executors' tasks are interrupted.
    A result that is there when the timer fires counts.
    """
    if seconds is None or seconds <= 0:
        return run()
    context, tag, late = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def cut() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cut)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        return run()
    except Exception as x:
        if late.is_set():
            raise DeadlineExceeded(seconds) from x
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
