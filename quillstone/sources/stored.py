"""Stored tables that change in place: only touched buckets are written anew. [S18-S22, S28, S29, I21, I22]

A table is dealt to buckets by a hash of its key, or of a part of it. A change reads the buckets that its keys fall into, writes their new
rows to a folder of the next version and then names, in one manifest put in place by a rename, the version that
holds each bucket. Until that rename readers see the old rows; a job that dies before it leaves a folder that no manifest
names. Two changes at once cannot both take the next version's name: the second one fails and is tried again by its caller.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.storage import kept

BUCKETS = 64


class ConflictError(RuntimeError):
    """Another change took the next version."""


class StoredTable:
    """A table at a folder, by key columns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifest ---------------------------------------------------------

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def manifest(self) -> dict:
        """The newest manifest: version, keys, buckets, schema and the version of each bucket that has rows."""
        versions = [int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json")]
        if not versions:
            raise FileNotFoundError(f"no table at {self.path}")
        stream = self._fs.open(self._at("manifest", f"{max(versions)}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        draft, final = self._at("manifest", f"_{manifest['version']}-{manifest['by']}"), self._at("manifest", f"{manifest['version']}.json")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode("utf-8")))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConflictError(f"version {manifest['version']} of {self.path} is taken")

    # --- reading ----------------------------------------------------------

    def read(self, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows as of the newest manifest; of some buckets only their files are opened."""
        m = manifest or self.manifest()
        schema = StructType.fromJson(m["schema"])
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(m["at"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, m: dict):
        return F.pmod(F.xxhash64(*m["dealt"]), F.lit(m["buckets"])).cast("int")

    def buckets_of(self, keys: DataFrame, m: dict) -> list[int]:
        """Buckets that some keys fall into: as many as the table has at the most."""
        return sorted(r["b"] for r in keys.select(self._bucket(m).alias("b")).distinct().collect())

    # --- writing ----------------------------------------------------------

    def _write(self, rows: DataFrame, m: dict, touched: list[int] | None) -> None:
        folder = f"{m['version'] + 1}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("bucket", self._bucket(m)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        fresh = {n.removeprefix("bucket="): folder for n in self._names("data", folder) if n.startswith("bucket=")}
        old = {b: v for b, v in m["at"].items() if touched is not None and int(b) not in touched}
        self._commit(m | {"version": m["version"] + 1, "by": folder, "at": old | fresh})

    def create(self, rows: DataFrame, keys: list[str], buckets: int = BUCKETS, dealt: list[str] | None = None) -> StoredTable:
        """A new table, or a new version of all of an old one; dealt to buckets by some of its key columns, or by all."""
        version = self.manifest()["version"] if self._names("manifest") else 0
        self._write(rows, {"version": version, "by": "", "keys": keys, "dealt": dealt or keys, "buckets": buckets, "schema": rows.schema.jsonValue(), "at": {}}, None)
        return self

    def change(self, keys: DataFrame, rewrite: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrite the buckets of some keys; how many they are."""
        m = self.manifest()
        touched = self.buckets_of(keys, m)
        if touched:
            columns = StructType.fromJson(m["schema"]).names
            self._write(rewrite(self.read(touched, m)).select(*columns), m, touched)
        return len(touched)

    def upsert(self, fresh: DataFrame) -> int:
        """Rows of fresh put in, in place of those of their key. [S20, I21, I22]"""
        keys = self.manifest()["keys"]
        fresh = kept(fresh.dropDuplicates(keys), "fresh")
        return self.change(fresh, lambda old: old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh))

    def insert_missing(self, fresh: DataFrame) -> int:
        """Rows of fresh whose key the table lacks are put in; how many. [S18, S19, S29]"""
        m = self.manifest()
        fresh = fresh.dropDuplicates(m["keys"])
        held = self.read(self.buckets_of(fresh, m), m).select(*m["keys"])
        new = kept(fresh.join(held, m["keys"], "left_anti"), "fresh")
        n = new.count()
        if n:
            self.change(new, lambda old: old.unionByName(new))
        return n

    def delete(self, dead: DataFrame, column: str | None = None) -> DataFrame:
        """Rows gone whose column (the key by default) stands in dead, a table of that one column; their keys, kept. [S21]"""
        m = self.manifest()
        on = [column] if column else m["keys"]
        if set(m["dealt"]) <= set(on):
            dead = kept(dead.select(*on).distinct(), "dead")
            gone = kept(self.read(self.buckets_of(dead, m), m).join(dead, on, "left_semi").select(*m["keys"]), "gone")
        else:
            gone = kept(self.read(manifest=m).join(dead.select(*on).distinct(), on, "left_semi").select(*m["keys"]), "gone")
        self.change(gone, lambda old: old.join(gone, m["keys"], "left_anti"))
        return gone

    def replace_children(self, fresh: DataFrame, parent: str) -> None:
        """All rows of the parents in fresh replaced by those of fresh. [I11, I21, S21]"""
        fresh = kept(fresh, "fresh")
        self.delete(fresh.select(parent).distinct(), parent)
        self.upsert(fresh)

    def vacuum(self) -> int:
        """Folders that the newest manifest does not name are deleted; how many. Readers of older versions must be done."""
        used = set(self.manifest()["at"].values())
        old = [n for n in self._names("data") if n not in used]
        for n in old:
            self._fs.delete(self._at("data", n), True)
        return len(old)


def cascade(dead: DataFrame, chain: list[tuple[StoredTable, str]]) -> list[int]:
    """Rows of dead ids go from a chain of (table, its column of the parent's key), with their children down the chain; how many of each. [S22, S28, J10]"""
    out = []
    for table, parent in chain:
        gone = table.delete(dead.toDF(parent), parent)
        out.append(gone.count())
        dead = gone
    return out
