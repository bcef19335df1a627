"""Sinks: stage store (compute once, read afterwards) and CSV reports."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import reliable_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location, removed when the driver's JVM ends."""
    path = f"{reliable_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


class StageStore:
    """Named Parquet stages under one root. A stage is complete once its _SUCCESS marker exists."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def cache_or_compute(self, name: str, compute: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
        if not self.has(name):
            df = compute()
            if partition_by:  # one writer task per (partition value, slice): few files, hot values stay split
                df = df.repartition(*[F.col(c) for c in partition_by], F.pmod(F.xxhash64(*df.columns), F.lit(8)))
            w = df.write.mode("overwrite")
            (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Table bucketed and sorted by `key`: later joins, aggregates and windows on the key read it without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_report(df: DataFrame, path: str, sort_by: str, part_rows: int = 1_000_000) -> str:
    """A report sorted by `sort_by`, largest first, as CSV: one file up to `part_rows` rows, else several that follow each
    other by name, each a range of its own."""
    parts = max(1, -(-df.count() // part_rows))
    order = F.col(sort_by).desc()
    spread = df.repartitionByRange(parts, order) if parts > 1 else df.coalesce(1)
    spread.sortWithinPartitions(order).write.mode("overwrite").csv(path, header=True)
    return path
