"""Joins that stay even when a few keys hold a large share of the probing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagelattice.session import cut_lineage

#: (key, ``_copies``): keys that are spread, with the number of tasks each is spread over.
Heavy = DataFrame


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, key: str, spread: int | None = None) -> Heavy:
    """Keys that would fill more than one of ``spread`` even partitions: (key, ``_copies``).

    Counts are exact and combined before the shuffle. Keys above the mean of a partition are fewer
    than ``spread`` whatever the data, and their copies together at most three times ``spread``.
    """
    spread = spread or partitions(df)
    keyed = df.where(F.col(key).isNotNull()).select(key)
    total = keyed.count()
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & (F.col("_n") * spread > total))
    share = F.floor(F.col("_n") * spread / max(total, 1))
    return cut_lineage(counts.select(key, F.pow(2, F.floor(F.log2(share)) + 1).cast("int").alias("_copies")))


def _with_copies(df: DataFrame, key: str, heavy: Heavy) -> DataFrame:
    """Broadcast on purpose: ``heavy`` has fewer rows than a shuffle has partitions."""
    named = F.broadcast(heavy.select(F.col(heavy.columns[0]).alias("_heavy"), "_copies"))
    return df.join(named, F.col(key) == F.col("_heavy"), "left").drop("_heavy").withColumn("_copies", F.coalesce("_copies", F.lit(1)))


def salted(df: DataFrame, key: str, heavy: Heavy) -> DataFrame:
    """Rows of the probing side with a salt below the number of copies of their key.

    The salt follows from the partition a row is read in and from its own content, so a task that
    runs again after an executor was lost sends every row where it went before, and equal rows of
    different partitions part. Maps and variants cannot be hashed and are left out.
    """
    plain = [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *plain), "_copies").cast("int")
    return _with_copies(df, key, heavy).withColumn("_salt", salt).drop("_copies")


def repeated(df: DataFrame, key: str, heavy: Heavy) -> DataFrame:
    """Rows of the other side, once per salt of their key."""
    salts = F.sequence(F.lit(0), F.col("_copies") - 1)
    return _with_copies(df, key, heavy).withColumn("_salt", F.explode(salts)).drop("_copies")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    heavy: Heavy | None = None,
) -> DataFrame:
    """Equi-join whose heavy left keys are spread over several tasks.

    ``right`` holds at most a bounded number of rows per key. Its rows for heavy keys are
    repeated once per salt; every other row travels once. The result is that of the plain join
    for any ``heavy``. ``heavy=None`` measures it from ``left``, which is then read more often.
    """
    if heavy is None:
        heavy = heavy_keys(left, key)
    if heavy.isEmpty():
        return left.join(right, key, how)
    joined = salted(left, key, heavy).join(repeated(right, key, heavy), [key, "_salt"], how)
    return joined.drop("_salt")
