"""Sorted sweep over ranges and points. [J18, T5]"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a bin: a file of any size is swept by many tasks, and a range is carried into each further bin that has points.
BIN = 4096


def _swept(schema: pa.Schema):
    """Sorted events of (key, bin) -> one row per point that lies in a range: the open range that began last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        open_: list[tuple] = []
        for batch in batches:
            rows, inner = [], []
            columns = [batch.column(c).to_pylist() for c in ("key", "bin", "at", "is_point", "end", "range_id")]
            for i, (key, bin_, at, is_point, end, range_id) in enumerate(zip(*columns, strict=True)):
                if (key, bin_) != now:
                    now, open_ = (key, bin_), []
                if not is_point:
                    open_.append((end, range_id))
                    continue
                # What ended before this point is over for all that follow; below the top it waits until it comes up.
                while open_ and open_[-1][0] < at:
                    open_.pop()
                if open_:
                    rows.append(i)
                    inner.append(open_[-1][1])
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(row), batch.column("point_id").take(row), pa.array(inner, schema.field("range_id").type)], schema=schema)

    return run


def innermost(ranges: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """points(key, point_id, at) with the range (range_id, r_start, r_end) that holds it and began last; of equal starts the one
    that ends first, then the smallest id. Points in no range, and rows with a null key or place, are left out. [J18, T5]

    One pass over each bin's sorted starts and points with a stack of open ranges: one row a point comes out, however many ranges
    hold it.
    """
    p = points.filter(F.col(key).isNotNull() & F.col("at").isNotNull()).select(F.col(key).alias("key"), F.floor(F.col("at") / BIN).alias("bin"), F.col("at").cast("long").alias("at"), "point_id")
    r = ranges.filter(F.col(key).isNotNull() & (F.col("r_start") <= F.col("r_end"))).select(
        F.col(key).alias("key"), F.explode(F.sequence(F.floor(F.col("r_start") / BIN), F.floor(F.col("r_end") / BIN))).alias("bin"), F.col("r_start").cast("long").alias("at"), F.col("r_end").cast("long").alias("end"), "range_id"
    )
    p = p.withColumn("is_point", F.lit(True))
    both = r.withColumn("is_point", F.lit(False)).unionByName(p, allowMissingColumns=True)
    order = ("key", "bin", "at", "is_point", F.desc("end"), F.desc("range_id"))
    dealt = both.repartition("key", "bin").sortWithinPartitions(*order).select("key", "bin", "at", "is_point", "end", "range_id", "point_id")
    types = {f.name: f for f in dealt.schema}
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    out = StructType([StructField(c, types[c].dataType) for c in ("key", "point_id", "range_id")])
    return dealt.mapInArrow(_swept(to_arrow_schema(out)), out).withColumnRenamed("key", key)
