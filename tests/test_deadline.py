"""Deadlines: a slow search is cut, a parallel one ends well."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from quillstone.operators.deadline import DeadlineExceeded, within


def slow(spark, seconds):
    wait = F.udf(lambda i: time.sleep(seconds) or i, "long")
    return lambda: spark.range(2, numPartitions=2).select(wait("id")).collect()


def test_a_slow_search_is_cut_and_a_parallel_one_ends_well(spark):
    spark.range(1).collect()
    found = []
    other = threading.Thread(target=lambda: found.extend(within(spark, 60, slow(spark, 4))))
    other.start()
    began = time.perf_counter()
    with pytest.raises(DeadlineExceeded) as x:
        within(spark, 1.5, slow(spark, 30))
    assert time.perf_counter() - began < 15 and x.value.seconds == 1.5
    other.join(60)
    assert len(found) == 2
    # The session goes on, also in this thread.
    assert within(spark, 30, lambda: spark.range(5).count()) == 5


def test_without_a_deadline_and_with_other_errors(spark):
    assert within(spark, None, lambda: spark.range(3).count()) == 3 and within(spark, 0, lambda: 7) == 7
    with pytest.raises(ZeroDivisionError):
        within(spark, 30, lambda: 1 // 0)
    assert not spark.sparkContext.getJobTags()
