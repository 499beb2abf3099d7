"""Session set-up, lineage cutting and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before it is no longer broadcast.
BROADCAST_ROWS = 100_000


def build_session(app: str = "trawlkit", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only for a local master."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="trawlkit-checkpoints-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder, for tables written mid-job."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def written_table(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """The rows as a table in the shared checkpoint folder, without a known partitioning."""
    path = scratch_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A lookup side: broadcast only after counting.

    A larger side is written out first. The join then stands on two plain shuffles, and AQE can
    split the keys that hold too many rows of the other side.
    """
    return F.broadcast(df) if small_enough(df, rows) else written_table(df, "lookup")


def lookup_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same for a side that is costly to compute: written out before it is counted."""
    table = written_table(df, "lookup")
    return F.broadcast(table) if small_enough(table, rows) else table


class BucketedTable:
    """Rows bucketed by their keys in the shared checkpoint folder, added round by round.

    Rows of one bucket lie in one task's files whatever round they came in, so a join or
    aggregation on the keys moves none of them. A round is a partition of its own.
    """

    ROUND = "_round"

    def __init__(self, spark: SparkSession, name: str, keys: list[str], buckets: int | None = None):
        self.spark, self.keys = spark, keys
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = scratch_path(spark, name)
        self.table = f"{name}_{self.path[-32:]}"
        self.schema = None

    def add(self, df: DataFrame, number: int = 0) -> None:
        """Write the rows of a round, which may be derived from earlier rounds of this table."""
        self.schema = self.schema or df.schema
        writer = df.withColumn(self.ROUND, F.lit(number)).write.format("parquet").mode("append")
        writer.partitionBy(self.ROUND).bucketBy(self.buckets, *self.keys).option("path", self.path).saveAsTable(self.table)

    def rows(self, number: int | None = None) -> DataFrame:
        """All rows, or those of one round."""
        found = self.spark.table(self.table)
        return (found if number is None else found.where(F.col(self.ROUND) == number)).drop(self.ROUND)

    def close(self) -> DataFrame:
        """Forget the name in the catalog; the rows, read from their folder, stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)
