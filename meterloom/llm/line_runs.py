"""Line dedup against levelled sorted runs of line hashes, in DataFrame functions only.

A run is a table of (h1, h2, holders, top): 128 bits of a line's key, how many documents hold it, and the largest doc_id of
these where the run is the first to know the key. Runs are bucketed by h1 and sorted, so a batch meets them in merge joins
without moving them. Batches come from the largest doc_ids down: each is merge-anti-joined with the runs, which tells its
new keys from those that a larger doc_id holds already, and its own run goes to level 0. A level with `fanout` runs is
compacted into one run of the next. The last compaction of all levels gives the verdict on every key.
"""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import folder, matched, settle, written

KEY = ["h1", "h2"]
RUN = "h1 long, h2 long, holders long, top long, known boolean"
BLANKS = " \t\n\u000b\f\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, upper, upper.lower()))


def _row() -> Column:
    return F.xxhash64("text").alias("row")


def long_lines(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, row, pos, h1, h2, first: every line of `docs` (doc_id, text) with a key of `least` code points or more.
    `first` marks the first line of each key in its row, so sums of it count documents without a shuffle of their own."""
    keys = F.transform(F.split("text", "\n"), lambda line, i: F.struct(line_key(line).alias("key"), i.alias("pos")))
    keys = F.transform(F.filter(keys, lambda x: F.char_length(x["key"]) >= least),
                       lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"), x["pos"].alias("pos")))

    def marked(x, i, all_):
        before = all_[i - 1]
        return F.struct(x["pos"].alias("pos"), x["h1"].alias("h1"), x["h2"].alias("h2"),
                        F.when(i == 0, 1).when((before["h1"] == x["h1"]) & (before["h2"] == x["h2"]), 0).otherwise(1).alias("first"))

    # the outer transform binds the sorted lines once, for the look back at the line before
    flagged = F.transform(F.array(F.array_sort(keys)), lambda own: F.transform(own, lambda x, i: marked(x, i, own)))[0]
    return docs.select("doc_id", _row(), F.inline(flagged))


class Runs:
    """Levels of sorted runs in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels, self.paths = spark, fanout, [[]], {}
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _store(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = folder(self.spark, name)
        (run.write.option("path", self.paths[name]).bucketBy(self.buckets, "h1").sortBy(*KEY)
         .format("parquet").saveAsTable(name))
        return name

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def merged(self, names: list[str]) -> DataFrame:
        """One row for each key of these runs. The files are read without their buckets: Spark 4.1 plans a union of bucketed
        tables as if it kept the buckets, then drops them from the scans, and equal keys would not meet."""
        runs = [self.spark.read.schema(RUN).parquet(self.paths[name]) for name in names]
        return reduce(DataFrame.unionByName, runs).repartition(self.buckets, "h1").groupBy(*KEY).agg(F.sum("holders").alias("holders"), F.max("top").alias("top"), F.max("known").alias("known"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Those of `keys` that no run holds."""
        return reduce(lambda left, name: left.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti"), self.names(), keys)

    def add(self, keys: DataFrame) -> None:
        """A batch's own run: keys (h1, h2, holders, top), one row each. Keys of earlier runs only add their holders."""
        if self.names():
            keys = written(keys, "batch-keys")
            fresh = self.unseen(keys).withColumn("known", F.lit(True))
            again = keys.join(fresh.select(*KEY).hint("merge"), KEY, "left_anti")
            keys = fresh.unionByName(again.select(*KEY, "holders", F.lit(None).cast("long").alias("top"), F.lit(None).cast("boolean").alias("known")))
        else:
            keys = keys.withColumn("known", F.lit(True))
        self.levels[0].append(self._store(keys.repartition(self.buckets, "h1")))
        self._compact()

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            name = self._store(self.merged(level))
            for old in level:
                self.spark.sql(f"DROP TABLE {old}")
            self.levels[depth] = []
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(name)

    def close(self) -> None:
        for name in self.names():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batched(base: DataFrame, batches: int) -> Column:
    """The number of a row's batch, 0 for the largest ids; rows without an id are in the last one."""
    if batches < 2:
        return F.lit(0)
    cuts = base.select(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)], 10_000)).first()[0] or []
    return reduce(lambda out, cut: out + F.when(F.col("doc_id") >= cut, 0).otherwise(1), cuts, F.lit(0))


def verdicts(docs: DataFrame, least: int = 40, holders: int = 5, batches: int = 4, fanout: int = 3) -> tuple[DataFrame, DataFrame]:
    """All long lines of `docs`, and (h1, h2, top) of the keys that at least `holders` documents hold."""
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    lines = long_lines(base, least).withColumn("batch", _batched(base, batches))
    path = folder(spark, "long-lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = Runs(spark, fanout)
    for k in range(batches):
        own = lines.where(F.col("batch") == k).groupBy(*KEY).agg(F.sum("first").alias("holders"), F.max("doc_id").alias("top"))
        runs.add(own)
    often = written(runs.merged(runs.names()).where(F.col("holders") >= holders).select(*KEY, "top"), "often")
    runs.close()
    return lines.drop("batch"), often


def without_frequent(docs: DataFrame, least: int = 40, holders: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of `docs` (doc_id, text; other columns are not looked at).

    Lines are what \\n parts; a null or empty text is one empty line. Lines whose key has `least` code points or more and
    is held by at least `holders` rows lose all their lines but those of the largest doc_id that holds the key. Each row is
    a document of its own; rows that share the largest id all keep the line; a null id is smaller than any other.
    The number of batches and the fan-out change no result.
    """
    settle(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines, often = verdicts(base, least, holders, batches, fanout)
    gone = matched(lines.select("doc_id", "row", "pos", *KEY), often, KEY).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    keyed = base.withColumn("row", _row())
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left")
    whole = F.struct(F.split("text", "\n").alias("lines"), F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(F.split("text", "\n")))).alias("edge"))

    def between(x):  # the lines between two dropped ones, in one step for each gap
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["edge"]) - 2), lambda i: F.slice(x["lines"], x["edge"][i] + 2, x["edge"][i + 1] - x["edge"][i] - 1))), "\n")

    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.transform(F.array(whole), between)[0])
    return joined.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
