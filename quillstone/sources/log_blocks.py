"""The tail of a log, read from its end. [S13, S14, S31]

A log is the files of a folder in the order of their names (or one file). It is cut into byte blocks, counted from the end;
a data source reads any stretch of them, one partition a block, and a line belongs to the block in which it begins. The search
takes the last block, then as many again as it has taken, until enough lines match: a hit near the end
costs a few blocks, whatever the log's size.

Executors open the files with Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillstone.sources.files import log_tail
from quillstone.storage import kept

BLOCK = 4 << 20
#: Bytes read at a time beyond a block's end, where its last line ends.
STEP = 1 << 16
LINES = "number long, value string"


@dataclass
class Block(InputPartition):
    """Bytes start to end of a file that begins at `before` in the log."""

    path: str
    before: int
    start: int
    end: int


def opened(path: str):
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(parts.path)
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def lines_of(block: Block) -> Iterator[tuple[int, bytes]]:
    """(place in the log, line) of every line that begins in a block."""
    with opened(block.path) as file:
        size = file.size()
        # The byte before the block tells whether a line begins with it.
        at = max(0, block.start - 1)
        file.seek(at)
        data = file.read(block.end - at)
        begin = 0
        if block.start:
            begin = data.find(b"\n") + 1
            if not begin:
                return
        while not data.endswith(b"\n") and at + len(data) < size:
            more = file.read(STEP)
            cut = more.find(b"\n")
            data += more if cut < 0 else more[: cut + 1]
            if cut >= 0:
                break
        while begin < len(data) and at + begin < block.end:
            end = data.find(b"\n", begin)
            end = len(data) if end < 0 else end
            yield block.before + at + begin, data[begin:end].removesuffix(b"\r")
            begin = end + 1


class LogBlocks(DataSource):
    """format("log_blocks"): the lines of a stretch of blocks; option blocks holds them as path|before|start|end lines."""

    @classmethod
    def name(cls) -> str:
        return "log_blocks"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["blocks"])


class LogReader(DataSourceReader):
    def __init__(self, blocks: str):
        rows = (line.rsplit("|", 3) for line in blocks.split("\n"))
        self.blocks = [Block(p, int(b), int(s), int(e)) for p, b, s, e in rows]

    def partitions(self) -> list[Block]:
        return self.blocks

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        places, values = [], []
        for place, line in lines_of(partition):
            places.append(place)
            values.append(line.decode("utf-8", "replace"))
            if len(places) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(values, pa.string())], ["number", "value"])
                places, values = [], []
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(values, pa.string())], ["number", "value"])


def blocks_of(spark: SparkSession, path: str, block: int = BLOCK) -> list[Block]:
    """The blocks of a log, the last first; only the files' names and sizes are asked for."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [s for s in system.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    out, before = [], 0
    for s in sorted(files, key=lambda s: s.getPath().getName()):
        size, name = s.getLen(), s.getPath().toString()
        cuts = [*range(size, 0, -block), 0]
        out += [Block(name, before, a, b) for b, a in zip(cuts[:-1], cuts[1:], strict=True)][::-1]
        before += size
    return out[::-1]


@dataclass
class Tail:
    """The last matching lines in order, and what was read for them."""

    rows: DataFrame
    blocks: int
    bytes: int
    of_bytes: int


def tail(spark: SparkSession, path: str, k: int, min_level: str | None = None, logger: str = "", words: str = "", block: int = BLOCK) -> Tail:
    """The last k matching lines of a log as log_tail gives them; each round is one job over the blocks that it adds."""
    spark.dataSource.register(LogBlocks)
    every = blocks_of(spark, path, block)
    found, taken = None, 0
    while taken < len(every) or found is None:
        fresh = every[taken : max(1, 2 * taken)]
        taken += len(fresh)
        if fresh:
            option = "\n".join(f"{b.path}|{b.before}|{b.start}|{b.end}" for b in fresh)
            lines = spark.read.format("log_blocks").option("blocks", option).load()
        else:
            lines = spark.createDataFrame([], LINES)
        more = kept(log_tail(lines, k, min_level, logger, words), "tail")
        found = more if found is None else kept(found.unionByName(more).orderBy(F.desc("number")).limit(k), "tail")
        if found.count() >= k:
            break
    size = lambda blocks: sum(b.end - b.start for b in blocks)
    return Tail(found.orderBy("number"), taken, size(every[:taken]), size(every))
