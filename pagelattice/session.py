"""Session settings and the shared scratch location used by iterative and streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are planned for. Broadcasts stay behind Catalyst's own size
# check (autoBroadcastJoinThreshold), but for the few heavy keys of skewed joins and for
# look-up sides whose rows were counted first.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets AQE hash instead of sort when every partition of the narrow side is small, which
    # spares sorting whole pages in the page-with-references join.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Whole pages travel in Arrow batches only on their way into an archive; keep batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Checkpointed levels and look-up inputs go once nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Expressions here are large; recording the caller of each Column operation doubles the
    # time to build them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, else one below the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    below = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    spark.sparkContext.setCheckpointDir(below)
    return below


def delete_path(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


class LaidOut:
    """A table bucketed on ``keys`` in the shared folder, to which rows may be added.

    Joins on the keys read it in place, however often: each row is shuffled once, when it is added.
    """

    def __init__(self, spark: SparkSession, *keys: str):
        self.spark, self.keys = spark, keys
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"laid_out_{uuid.uuid4().hex}"
        self.path = scratch_path(spark, "laid-out")

    def add(self, df: DataFrame) -> None:
        writer = df.repartition(self.buckets, *self.keys).write.format("parquet").bucketBy(self.buckets, *self.keys)
        writer.mode("append").option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


@contextmanager
def laid_out_by(df: DataFrame, *keys: str) -> Iterator[DataFrame]:
    """The rows laid out by ``keys``; table and files go when the block ends."""
    table = LaidOut(df.sparkSession, *keys)
    try:
        table.add(df)
        yield table.rows()
    finally:
        table.drop()
