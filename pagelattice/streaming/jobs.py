"""Captures that keep arriving.

Every job reads new parquet files of captures and stops when it has caught up
(``availableNow``), so a repeated run picks up where the last one ended.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from pagelattice import schemas
from pagelattice.functions import urls
from pagelattice.operators import scan, snapshots
from pagelattice.session import cut_lineage
from pagelattice.sources import state as state_io

_KEYS = T.StructType([T.StructField("key", T.StringType()), T.StructField("batch", T.LongType())])


def read_captures(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Stream of page captures in a folder, or in all that a glob of files and folders meets.

    ``pattern`` holds for the names of data files. ``files_per_batch`` bounds a micro-batch, not the result.
    """
    reader = spark.readStream.schema(schemas.PAGES).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_state(captures: DataFrame, state_path: str, checkpoint: str, ts: Column | None = None) -> StreamingQuery:
    """Each batch: append its new and changed captures to the state.

    Only the buckets of the state that the batch falls into are read, and only the rows that changed are
    written. A batch that is replayed after its rows were saved is known by its number and adds nothing.
    """
    stamp = F.current_timestamp() if ts is None else ts
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def step(batch: DataFrame, number: int) -> None:
        log = state_io.state_log(batch.sparkSession, state_path)
        tag = f"{stream}.{number}"
        if log.saved(tag):
            return
        captured = cut_lineage(snapshots.latest_per_url(snapshots.page_captures(batch, stamp)))
        log.append(snapshots.changed_captures(captured, log.rows_for(captured)), tag)

    writer = captures.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stream_findings(captures: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Findings of arriving pages appended to a parquet table; stateless."""
    found = scan.all_findings(scan.page_texts(captures))
    writer = found.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(out)


def stream_dedupe(captures: DataFrame, out: str, checkpoint: str, within: tuple[str, str] | None = None) -> StreamingQuery:
    """First capture per page key, the one of lowest ``page_id`` within a batch.

    ``within`` = (time column, delay) lets Spark forget keys once the watermark has passed.
    Without it each batch is a folder ``batch=N`` of the output, and its keys are a delta of a key log
    beside them, ``_keys``: keys are combined before their shuffle and held against the buckets of the log that they fall into, on narrow
    rows; page text stays in place. A batch that is replayed writes its folder anew; its own keys are known by its number.
    """
    keyed = captures.withColumn("key", urls.captured_key(F.col("url")))
    if within:
        column, delay = within
        kept = keyed.withWatermark(column, delay).dropDuplicatesWithinWatermark(["key"])
        writer = kept.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(availableNow=True).start(out)

    def step(batch: DataFrame, number: int) -> None:
        log = state_io.BucketLog(batch.sparkSession, f"{out}/_keys", _KEYS, "key")
        batch = batch.withColumn("_row", F.monotonically_increasing_id())
        first = cut_lineage(batch.groupBy("key").agg(F.min(F.struct("page_id", "_row")).alias("first")))
        known = log.rows_for(first).where(F.col("batch") < number)
        fresh = cut_lineage(first.join(known.select("key"), "key", "left_anti"))
        kept = batch.join(fresh.select(F.col("first._row").alias("_row")), "_row", "left_semi").drop("_row")
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if not log.saved(str(number)):
            log.append(fresh.select("key", F.lit(number).cast("bigint").alias("batch")), str(number))

    writer = keyed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
