"""Append-only step streams of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "cursor long, run_id string, file_path string, number int, kind string, tool_name string, arguments string, detail string, duration_ms int, is_error boolean, created_at timestamp"


def with_cursor(steps: DataFrame, after: int, order: list[str]) -> DataFrame:
    """Cursors that go on from the last one, by rank in a partitioned order. [X1]

    Ranks come from counts per hour and a rank inside the hour, so no task orders all steps.
    """
    from pyspark.sql import Window

    hour = F.date_trunc("hour", F.col(order[0]))
    counted = steps.withColumn("_h", hour)
    per = counted.groupBy("_h").agg(F.count("*").alias("_n"))
    before = per.withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_h").orderBy(*order))
    return counted.withColumn("_r", rank).join(before, "_h").withColumn("cursor", F.lit(after) + F.col("_from") + F.col("_r")).drop("_h", "_r", "_from")


def read_steps(spark: SparkSession, path: str, schema: str = STEP) -> DataFrame:
    """Steps as a file stream. [X3]"""
    return spark.readStream.schema(schema).parquet(path)


def live_steps(stream: DataFrame, run_id: str | None = None, delay: str = "10 minutes", time: str = "created_at") -> DataFrame:
    """A stream without repeats of a run's cursor; state is dropped after the delay. [X2, X3]"""
    rows = stream if run_id is None else stream.filter(F.col("run_id") == run_id)
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["run_id", "cursor"])


def replayed(history: DataFrame, tail: DataFrame, run_id=None) -> DataFrame:
    """Stored steps and the ones that came since, each once, in order; of one run if named. [X2, X3]"""
    of = lambda df: df if run_id is None else df.filter(F.col("run_id") == F.lit(run_id))
    return of(history).unionByName(of(tail)).dropDuplicates(["run_id", "cursor"]).orderBy("run_id", "cursor")


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Our extension: events per tumbling window and key."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def record(stream: DataFrame, path: str, checkpoint: str, publish: Callable[[DataFrame], None] | None = None):
    """Append each batch, then hand it on; a failing listener never stops the stream. [X1, X4, X12]"""

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(path)
        if publish is not None:
            try:
                publish(batch)
            except Exception as x:  # noqa: BLE001  listeners are optional
                print(f"publishing failed: {x}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def encode(steps: DataFrame) -> DataFrame:
    """[X11]"""
    return steps.select("run_id", F.to_json(F.struct(*[c for c in steps.columns if c != "run_id"])).alias("value"))


def decode(messages: DataFrame, schema: str = STEP) -> DataFrame:
    """[X11]"""
    return messages.select(F.from_json("value", schema).alias("s")).select("s.*")


def envelope(events: DataFrame, name: str) -> DataFrame:
    """{event, data} of each row. [X4]"""
    return events.select(F.to_json(F.struct(F.lit(name).alias("event"), F.struct(*events.columns).alias("data"))).alias("value"))
