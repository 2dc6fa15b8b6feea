"""Helpers shared by the operators: stored intermediate tables, checked broadcasts, empty batches."""

from __future__ import annotations

import os
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelattice.session import delete_path, scratch_path

#: Rows of a narrow look-up side up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of words up to which a look-up side that holds words is broadcast.
BROADCAST_BYTES = 64 << 20


class Scratch:
    """Tables written to the folder all executors share; those not kept are deleted at the end.

    A written table cuts lineage: a lost executor costs the running stage, not the steps before it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, label: str, keep: bool = False) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            delete_path(self.spark, path)
        self.paths = []


@contextmanager
def scratch(spark: SparkSession):
    tables = Scratch(spark)
    try:
        yield tables
    finally:
        tables.drop()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, for tasks in Python."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(context._temp_dir, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in package.rglob("*.py"):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few enough, else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
