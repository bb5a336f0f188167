"""Resolution of edges kept up to date: only names that a build touched are resolved again. [I12, A8, A9, S20]

Two stored tables, both dealt by the last segment of the name: the symbols, which are the state that says how often a
name occurs, and the edges with what they held before resolution. Whether a full name or a last segment is unique
is settled by symbols of one last segment alone, so the edges that a change can turn have one of its segments as
theirs. The others, and their buckets' files, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.graph import resolve_edges
from quillstone.sources.stored import StoredTable
from quillstone.storage import kept

SYMBOL = ("symbol_id", "file_id", "kind", "qualified_name", "start_line")


def _segmented(rows: DataFrame, name: str) -> DataFrame:
    """An edge without a name has the segment '' and never meets a symbol."""
    return rows.withColumn("segment", F.coalesce(T.last_segment(F.col(name)), F.lit("")))


class NameIndex:
    """Stored symbols and resolved edges at a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.symbols, self.stored = StoredTable(spark, f"{path}/symbols"), StoredTable(spark, f"{path}/edges")

    @staticmethod
    def _open(edges: DataFrame) -> DataFrame:
        """Edges with what they held before resolution beside."""
        return edges.withColumn("target_0", F.col("target_symbol_id")).withColumn("confidence_0", F.col("confidence"))

    @staticmethod
    def _resolved(edges: DataFrame, symbols: DataFrame) -> DataFrame:
        """Edges as before resolution, resolved."""
        raw = edges.withColumn("target_symbol_id", F.col("target_0")).withColumn("confidence", F.col("confidence_0"))
        return resolve_edges(raw, symbols.select(*SYMBOL)).drop("target_name")

    def create(self, symbols: DataFrame, edges: DataFrame, buckets: int = 256) -> NameIndex:
        self.symbols.create(_segmented(symbols.select(*SYMBOL), "qualified_name"), ["segment", "symbol_id"], buckets, ["segment"])
        fresh = self._resolved(self._open(_segmented(edges, "target_qualified_name")), symbols)
        self.stored.create(fresh, ["segment", "edge_id"], buckets, ["segment"])
        return self

    def edges(self) -> DataFrame:
        return self.stored.read().drop("segment", "target_0", "confidence_0")

    def apply(self, removed: DataFrame, added: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """Symbols removed and added by a build, and its new edges; a changed symbol is in both. The segments touched, kept."""
        gone, new = (_segmented(df.select(*SYMBOL), "qualified_name") for df in (removed, added))
        touched = gone.select("segment").unionByName(new.select("segment"))
        if edges is not None:
            fresh = kept(self._open(_segmented(edges, "target_qualified_name")), "edges")
            touched = touched.unionByName(fresh.select("segment"))
        touched = kept(touched.distinct(), "touched")
        self.symbols.delete(gone.select("segment", "symbol_id"))
        self.symbols.upsert(new)
        m = self.symbols.manifest()
        near = self.symbols.read(self.symbols.buckets_of(touched, m), m).join(touched, "segment", "left_semi")

        def again(old: DataFrame) -> DataFrame:
            turned = old.join(touched, "segment", "left_semi")
            if edges is not None:
                turned = turned.join(fresh.select("segment", "edge_id"), ["segment", "edge_id"], "left_anti").unionByName(fresh.select(*old.columns))
            return old.join(touched, "segment", "left_anti").unionByName(self._resolved(turned, near).select(*old.columns))

        self.stored.change(touched, again)
        return touched
