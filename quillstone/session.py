"""Session settings and table loading shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: the number of partitions that tables of whole texts are dealt to when they are read. Unset, they are read as they lie.
#: A table of one file with one row group is read by one task, so small test tables gain by it; no size is looked at.
DEAL = "spark.quillstone.deal"
#: Tables of whole texts.
TEXTS = ("documents", "pages")

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; only columns used later are read."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    deal = spark.conf.get(DEAL, None) if name in TEXTS else None
    return rows.repartition(int(deal)) if deal else rows


def many_tasks(spark: SparkSession) -> int:
    """Partitions for rows that are few bytes and much work, which adaptive execution would put together."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def build_session(app: str = "quillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
