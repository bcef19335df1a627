"""Written tables in the shared folder, joins behind a size check, and what every operator does with its input."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.session import reliable_checkpoint_dir

#: Most rows of a broadcast side: one or two 64-bit columns, so at most a few tens of MB. Larger sides are shuffled.
BROADCAST_ROWS = 400_000


def settle(spark: SparkSession) -> None:
    """Batches that bound a Python worker's memory; adaptive execution with skewed joins split."""
    for k, v in {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
                 "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}.items():
        spark.conf.set(k, v)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{reliable_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Shuffle files of a finished write go at once, not when the driver's collector finds them; set for the write alone.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: computed once, kept when executors are lost."""
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that written() has made in this process, in order.
made: list[str] = []


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of written(), for callers that have written all they need from them."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def matched(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a written side of narrow rows: broadcast if it has at most BROADCAST_ROWS, else shuffled."""
    few = small.count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small.hint("shuffle_merge"), key, how)
