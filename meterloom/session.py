"""Session builder and the run-time settings the plans rely on."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Run-time settings that change speed only, never results; batches of Arrow rows are no unit of any operator.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # percentile / collect_list buffers are small per series: stay hash based
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("meterloom")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for k, v in {**RUNTIME_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    tune(spark)
    return spark


#: A shuffle of series is read by tasks of so many bytes at most, as a sparse row becomes many dense ones, and dealt into
#: a partition for each INPUT_BYTES of the tables read, so that neither grows with the input.
ADVISORY, INITIAL = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
TASK_BYTES, INPUT_BYTES = 2 << 20, 1 << 20
#: Rows of the table read whose series one task makes dense. A sort and a hash table of the dense rows then fit in a page
#: of memory each, however well the table or the shuffle is compressed. A task that reads the table takes READ_ROWS at most,
#: as far as row groups allow, since its sums by series and day have hardly fewer rows.
TASK_ROWS, READ_ROWS = 50_000, 400_000
READ = "spark.sql.files.maxPartitionBytes"
_given: dict[str, str | None] = {}


def tune(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    for k, v in _given.items():  # what spread() set for the query before
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    _given.clear()
    return spark


def _size(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _set_partitions(spark: SparkSession, wanted: int) -> int:
    """At least `wanted` partitions for the shuffles of the query that is being built; returns `wanted`, bounded."""
    wanted = max(1, min(wanted, 1 << 14))
    now = int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    _set(spark, INITIAL, str(max(now, wanted)))
    _set(spark, ADVISORY, f"{TASK_BYTES}b")
    return wanted


def _set(spark: SparkSession, key: str, value: str) -> None:
    """For the query that is being built; tune() gives the session's own value to the next."""
    _given.setdefault(key, spark.conf.get(key, None))
    spark.conf.set(key, value)


def spread(df: DataFrame) -> DataFrame:
    """The same table; shuffles of the queries on it get a number of partitions that follows its size on disk."""
    _set_partitions(df.sparkSession, -(-_size(df) // INPUT_BYTES))
    return df


def series_tasks(df: DataFrame) -> int:
    """Number of tasks that the series in a table read from files are dealt into; it follows the rows (read from the files'
    footers), as do the tasks that read it. Other shuffles get as many partitions, so that a join by series moves no dense rows."""
    spark, size, rows = df.sparkSession, _size(df), df.count()
    given = _given.get(READ) or spark.conf.get(READ)
    most = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(given))
    _set(spark, READ, f"{min(most, max(size * READ_ROWS // max(rows, 1), 1 << 20))}b")
    return _set_partitions(spark, max(-(-size // INPUT_BYTES), -(-rows // TASK_ROWS)))


#: Rows of a table with a row for each series that one task takes where the table is read again and again.
PASS_ROWS = 4_000


def gathered(df: DataFrame, key: str) -> DataFrame:
    """Materialized in tasks for passes over it: as many as follow its own rows, or up to those that run at once, however many
    tasks it took to make it. Rows dealt anew are in the order of `key`, so that learners that draw rows by their place draw the same."""
    x = cut_lineage(df)
    least = max(1, -(-x.count() // PASS_ROWS))
    if least <= x.rdd.getNumPartitions() <= max(least, df.sparkSession.sparkContext.defaultParallelism):
        return x
    return cut_lineage(x.repartition(least, key).sortWithinPartitions(key))


def reliable_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private folder only where none is set (local tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="meterloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df):
    """Reliable checkpoint: survives the loss of executors, stops iterative plans from growing."""
    reliable_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
