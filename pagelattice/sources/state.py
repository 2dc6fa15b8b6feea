"""State of earlier runs as a log of deltas over buckets of URL hashes.

A save appends one delta that holds its own rows alone, a folder per bucket they fall into: saving k rows
writes k rows, whatever the size of the state. A reader takes, of each bucket, its last compacted part and the deltas after
it; of several rows of a URL the later by time counts, then the later save. When ``compact_at`` deltas have
gathered, the buckets they touch, and no others, are written anew as parts of a base. Deltas and bases only count once Spark has
put ``_SUCCESS`` into them, so a crash anywhere leaves the state before or after a save, never a part of it. What a
compaction replaces is deleted by the next one, so that readers that began before it can end.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pagelattice import schemas
from pagelattice.session import delete_path

#: Deltas that gather before their buckets are compacted.
COMPACT_AT = 8


class BucketLog:
    """A table of one row per ``key``, kept as deltas and compacted buckets below ``path``.

    ``order`` names the columns by which the last row of a key is chosen, before the number of the save. The
    number of buckets is chosen by the first save, the shuffle partitions if not given, and stays.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: tuple[str, ...] = (), buckets: int | None = None, compact_at: int = COMPACT_AT):
        self.spark, self.schema, self.key, self.order, self.compact_at = spark, schema, key, order, compact_at
        made = [name for name in self._names(path) if name.startswith("buckets=")]
        self.buckets = int(made[0][8:]) if made else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = f"{path}/buckets={self.buckets}"

    def _names(self, path: str) -> list[str]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [status.getPath().getName() for status in fs.listStatus(root)] if fs.exists(root) else []

    def _folders(self, kind: str, complete: bool = True) -> list[tuple[int, str]]:
        """(number, folder name) of the deltas or bases, ascending."""
        found = [name for name in self._names(self.path) if name.startswith(f"{kind}=")]
        if complete:
            found = [name for name in found if "_SUCCESS" in self._names(f"{self.path}/{name}")]
        return sorted((int(name.split("=")[1].split("-")[0]), name) for name in found)

    def _parts(self, folder: str) -> set[int]:
        return {int(name[7:]) for name in self._names(f"{self.path}/{folder}") if name.startswith("bucket=")}

    def next_number(self) -> int:
        """Number the next save will get."""
        return max((n for kind in ("delta", "base") for n, _ in self._folders(kind, complete=False)), default=-1) + 1

    def saved(self, tag: str) -> bool:
        """Whether a delta with this tag is complete."""
        return any(name.endswith(f"-{tag}") for _, name in self._folders("delta"))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _last(self, rows: DataFrame) -> DataFrame:
        """One row per key, combined before the shuffle."""
        rest = [c for c in rows.columns if c != self.key]
        later = F.struct(*self.order, "_save", *[c for c in rest if c not in (*self.order, "_save")])
        best = F.max_by(F.struct(*rest), later).alias("s")
        return rows.groupBy(self.key).agg(best).select(self.key, *[F.col(f"s.{c}") for c in rest])

    def _write(self, rows: DataFrame, folder: str) -> None:
        placed = self._last(rows).withColumn("bucket", self.bucket())
        placed.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def append(self, rows: DataFrame, tag: str | None = None) -> int:
        """Save ``rows``; those of keys known before replace them. Returns the save's number."""
        number = self.next_number()
        self._write(rows.select(*self.schema.names, F.lit(number).cast("bigint").alias("_save")), f"delta={number}" + (f"-{tag}" if tag else ""))
        base = max((n for n, _ in self._folders("base")), default=-1)
        if sum(n > base for n, _ in self._folders("delta")) > self.compact_at:
            self.compact()
        return number

    def _layout(self) -> tuple[dict[int, str], list[tuple[int, str]]]:
        """The folder of each bucket's last base, and the deltas after the last base."""
        bases = self._folders("base")
        newest = {b: name for _, name in bases for b in self._parts(name)}
        return newest, [d for d in self._folders("delta") if not bases or d[0] > bases[-1][0]]

    def _stored(self, buckets: Iterable[int] | None) -> DataFrame:
        newest, deltas = self._layout()
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.path}/{name}/bucket={b}" for b, name in newest.items() if wanted is None or b in wanted]
        paths += [f"{self.path}/{name}/bucket={b}" for _, name in deltas for b in sorted(self._parts(name)) if wanted is None or b in wanted]
        layout = T.StructType([*self.schema, T.StructField("_save", T.LongType())])
        return self.spark.read.schema(layout).parquet(*paths) if paths else self.spark.createDataFrame([], layout)

    def rows(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The last row of every key, or of the keys in some buckets only; other buckets are not opened."""
        return self._last(self._stored(buckets)).select(*self.schema.names)

    def rows_for(self, keys: DataFrame) -> DataFrame:
        """The last rows of the buckets that ``keys`` fall into."""
        return self.rows([r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()])

    def compact(self) -> None:
        """Write the buckets that the deltas since the last base touch as parts of a new base."""
        newest, deltas = self._layout()
        if not deltas:
            return
        bases, before = self._folders("base"), self._folders("delta")
        touched = set().union(*[self._parts(name) for _, name in deltas])
        self._write(self._stored(touched), f"base={deltas[-1][0]}")
        # Replaced before this compaction: nobody who began to read since then looks at them.
        for number, name in before:
            if bases and number <= bases[-1][0]:
                delete_path(self.spark, f"{self.path}/{name}")
        for _, name in bases:
            old = [b for b in self._parts(name) if newest[b] != name]
            for b in old:
                delete_path(self.spark, f"{self.path}/{name}/bucket={b}")


def state_log(spark: SparkSession, path: str, buckets: int | None = None) -> BucketLog:
    return BucketLog(spark, path, schemas.STATE, "url", ("ts",), buckets)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """One row per URL ever saved; an empty table when there is none."""
    return state_log(spark, path).rows()


def next_run(spark: SparkSession, path: str) -> int:
    """Number the next save will get."""
    return state_log(spark, path).next_number()


def save_state(rows: DataFrame, path: str, buckets: int | None = None, tag: str | None = None) -> int:
    """Add new and changed rows to the state; the later row of a URL counts. Returns the save's number.

    ``tag`` names the save for ``BucketLog.saved``; ``buckets`` is heeded by the first save.
    """
    return state_log(rows.sparkSession, path, buckets).append(rows, tag)
