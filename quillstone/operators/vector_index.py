"""Inverted file of vectors: a search reads the lists of the nearest centroids alone. [R10, T3, R11]

Centroids are k-means centres of a bounded sample; every vector goes into the list of its nearest
one, a folder of its own, so a search names the folders that it opens. A list keeps its radius, the
largest angle of a member to the centroid. By the triangle inequality of angles no member of a
list scores above cos(angle(query, centroid) - radius): with exact=True the lists whose bound
reaches the kth score of the first probes are read as well, and the result is that of a full scan.

Rows without a vector, of another length than most or of length zero are left out; queries of another
length find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.search import cosine, norm
from quillstone.storage import kept, read_foldered, write_foldered

#: Vectors drawn for the centroids, centroids at most, and lists that a search reads by itself.
SAMPLE, CENTROIDS, PROBES = 20_000, 1024, 8
#: Queries and vectors that are scored against each other at once.
PACK, PIECE = 256, 512
#: Scores that differ by more do so after rounding to six places, and in that order.
SLACK = 2e-6


def build(vectors: DataFrame, path: str, id_col: str, vector_col: str, sample: int = SAMPLE, lists: int | None = None, seed: int = 7) -> None:
    """Write the index of vectors(id, vector) to a folder, replacing what is there."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(norm(F.col("vector")) > 0)
    # One length of vectors has an index; as in a full scan, a query meets vectors of its own length alone.
    most = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    n, width = (most["count"], most["width"]) if most else (0, 0)
    rows = rows.filter(F.size("vector") == width)
    # The sample only decides how the lists are cut, never what is in them.
    drawn = rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    k = lists or max(1, min(CENTROIDS, round(math.sqrt(n))))
    if not n:
        write_foldered(rows.select("id", "vector", F.lit(0).alias("list")), f"{path}/lists", "list")
        vectors.sparkSession.createDataFrame([], "list int, centroid array<double>, radius double").write.mode("overwrite").parquet(f"{path}/centroids")
        return
    model = KMeans(k=max(2, k), maxIter=10, initMode="random", seed=seed, distanceMeasure="cosine").fit(drawn)
    features = rows.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    placed = model.transform(features).select("id", "vector", F.col("prediction").alias("list"))
    # Rebalancing cuts a list that holds very many vectors into several files.
    write_foldered(placed.hint("rebalance", "list"), f"{path}/lists", "list")
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = vectors.sparkSession.createDataFrame(centres, "list int, centroid array<double>")
    stored = read_foldered(vectors.sparkSession, f"{path}/lists").join(F.broadcast(centroids), "list")
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(F.col("vector"), F.col("centroid")))))
    radii = stored.groupBy("list").agg(F.max(angle).alias("radius"))
    centroids.join(radii, "list").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def one_list(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, id, vector) -> arrays of at most PIECE rows of one list."""
    for batch in batches:
        lists = batch.column("list").to_numpy()
        for c in np.unique(lists):
            who = np.flatnonzero(lists == c)
            for a in range(0, len(who), PIECE):
                part = pa.array(who[a : a + PIECE])
                yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int32()), *(one_list(batch.column(x).take(part)) for x in ("id", "vector"))], ["list", "id", "v"])


def _scored(width: int, k: int):
    """Packs of queries beside pieces of their list -> of each query the rows of the piece that can be among its k best.

    A product of matrices finds them; their scores are then summed from left to right, as the columns of search.cosine are.
    """
    norms = lambda x: np.sqrt(np.cumsum(x * x, axis=1)[:, -1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda name: batch.column(name)[i].values  # noqa: B023, E731
                q_ids, ids = cell("q_id"), cell("id").to_pylist()
                q, v = (np.asarray(cell(c).flatten(), np.float64).reshape(-1, width) for c in ("q", "v"))
                nq, nv = norms(q), norms(v)
                near = q @ v.T / (nq[:, None] * nv[None, :])
                kth = np.partition(near, len(ids) - k, axis=1)[:, [len(ids) - k]] if len(ids) > k else np.full((len(q), 1), -2.0)
                # Written so that scores that are no numbers stay: they stand before all others.
                row, at = np.nonzero(~(near < np.maximum(kth, cell("least").to_numpy()[:, None]) - SLACK))
                score = np.cumsum(v[at] * q[row], axis=1)[:, -1] / (nv[at] * nq[row])
                if len(row) > 2 * k * len(q):  # of equal scores the k first ids
                    order = sorted(range(len(row)), key=lambda j: (row[j], score[j], ids[at[j]] is not None, ids[at[j]]))  # noqa: B023
                    new = np.r_[True, (np.diff(row[order]) != 0) | (np.diff(score[order]) != 0)]
                    run_at = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                    kept_ = np.array(order)[run_at < k]
                    row, at, score = row[kept_], at[kept_], score[kept_]
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), cell("id").take(pa.array(at)), pa.array(score)], ["query_id", "id", "score"])

    return run


class VectorIndex:
    """A built index, opened for searches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])
        self.names = np.array([r["list"] for r in rows], np.int64)
        self.centroids = np.array([r["centroid"] for r in rows])
        self.radii = np.array([r["radius"] for r in rows])

    def angles(self, query: list[float]) -> np.ndarray:
        q = np.asarray(query, float)
        return np.arccos(np.clip(self.centroids @ q / (np.linalg.norm(self.centroids, axis=1) * np.linalg.norm(q)), -1, 1))

    def nearest(self, query: list[float], probes: int) -> list[int]:
        """The lists of the nearest centroids, as many as probes."""
        return self.names[np.argsort(self.angles(query), kind="stable")[:probes]].tolist()

    def within(self, query: list[float], least: float) -> list[int]:
        """Every list that can hold a vector of that cosine or more; scores are rounded to six places."""
        angle = np.maximum(0, self.angles(query) - self.radii - 1e-9)
        return self.names[np.cos(angle) >= least - 1e-6].tolist()

    def rows(self, lists: list[int]) -> DataFrame:
        return read_foldered(self.spark, f"{self.path}/lists").filter(F.col("list").isin(lists) if lists else F.lit(False))

    def search(self, query: list[float], k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """(id, score): the k nearest of the probed lists; with exact of all vectors, for which one job finds the kth score first."""
        usable = len(query) > 0 and any(query) and len(self.names) > 0 and len(query) == self.centroids.shape[1]
        lists = self.nearest(query, probes) if usable else []
        asked = F.array(*[F.lit(float(x)) for x in query]) if usable else F.array(F.lit(0.0))

        def ranked(names: list[int]) -> DataFrame:
            scored = self.rows(names).select("id", F.round(cosine(F.col("vector"), asked), 6).alias("score"))
            return scored.filter("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)

        if exact and usable:
            found = ranked(lists).agg(F.count("*").alias("n"), F.min("score").alias("kth")).first()
            lists = self.within(query, found["kth"]) if found["n"] >= k else self.names.tolist()
        return ranked(lists)

    def search_all(self, queries: DataFrame, k: int, id_col: str = "query_id", vector_col: str = "vector", probes: int = PROBES, exact: bool = False) -> DataFrame:
        """(query_id, id, score, rank) for a table of queries: each meets its lists by a join on the list."""
        names, centroids, radii = self.names, self.centroids, self.radii
        all_queries = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query"))
        if not len(names):
            return all_queries.limit(0).select("query_id", F.lit(0).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        width = centroids.shape[1]
        good = all_queries.filter((F.size("query") == width) & (norm(F.col("query")) > 0))

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(a, 2048) for whole in batches for a in range(0, whole.num_rows, 2048)):
                q = np.asarray(batch.column("query").flatten(), float).reshape(-1, width)
                least = np.asarray(batch.column("least"))
                angle = np.arccos(np.clip(q @ centroids.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(centroids, axis=1)[None, :]), -1, 1))
                first = np.zeros(angle.shape, bool)
                np.put_along_axis(first, np.argsort(angle, axis=1, kind="stable")[:, :probes], True, axis=1)
                more = (np.cos(np.maximum(0, angle - radii - 1e-9)) >= least[:, None] - 1e-6) & ~first
                later = np.asarray(batch.column("later"))[:, None]
                visit = np.where(later, more, first)
                least = np.where(np.asarray(batch.column("later")), least, -2.0)
                for c in np.flatnonzero(visit.any(axis=0)):
                    who = np.flatnonzero(visit[:, c])
                    for a in range(0, len(who), PACK):
                        part = pa.array(who[a : a + PACK])
                        columns = [batch.column("query_id").take(part), batch.column("query").take(part), pa.array(least[who[a : a + PACK]])]
                        yield pa.RecordBatch.from_arrays([pa.array([int(names[c])], pa.int32()), *(one_list(x) for x in columns)], ["list", "q_id", "q", "least"])

        kinds = {f.name: f.dataType.simpleString() for f in good.schema}
        stored = read_foldered(self.spark, f"{self.path}/lists")
        held = {f.name: f.dataType.simpleString() for f in stored.schema}
        pieces = stored.select("list", "id", "vector").mapInArrow(_pieces, f"list int, id array<{held['id']}>, v array<{held['vector']}>")

        def hits(rows: DataFrame) -> DataFrame:
            packs = rows.mapInArrow(visits, f"list int, q_id array<{kinds['query_id']}>, q array<{kinds['query']}>, least array<double>")
            # Queries repeated per list are many times the rows that Spark sees: never broadcast.
            both = packs.join(pieces.hint("merge"), "list").mapInArrow(_scored(width, k), f"query_id {kinds['query_id']}, id {held['id']}, score double")
            return both.withColumn("score", F.round("score", 6)).filter("score IS NOT NULL")

        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = best(hits(good.withColumn("least", F.lit(2.0)).withColumn("later", F.lit(False))))
        if exact:
            found = kept(found, "probed").drop("rank")
            kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
            rest = good.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))).withColumn("later", F.lit(True))
            found = best(found.unionByName(hits(rest)))
        return found
