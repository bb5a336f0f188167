"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, mixing.

Each stage works on all that its predecessor kept, and its output is written as Parquet
and read again before the next begins, so a lost executor costs no finished stage. What a
stage writes on its way goes when its output stands, and the output when the next stands.

Every stage takes nulls in any column, empty and very long texts (read whole), ties, repeated
rows, an empty table (which stays empty) and extra columns of any name but _quill_*, which
all come back: null and empty texts are not toxic and hold no benchmark item; equal texts
count as copies, whatever their ids; a null id is never a near-copy and loses against any id
among equal texts; rows that share an id stand or fall together in the near-copy and
benchmark stages; the mix takes rows of one id, source and size evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from quillstone.llm.common import discard, keep, run_folder
from quillstone.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxicity.THRESHOLD or more go."""
    model = toxicity_model(spark, sf_dir, docs)
    scored = toxicity.score(docs, model, out_col="_quill_score")
    return scored.filter(F.col("_quill_score") < toxicity.THRESHOLD).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id stays."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Model fitting, Hamming links and alignment have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents, read from the last stage's output, which stays for the caller."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with run_folder(spark):
            done = stage(spark, docs, sf_dir)
            docs = keep(done, f"stage-{name}", apart=True)
        discard(before)
    return docs
