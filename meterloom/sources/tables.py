"""Canonical tables derived from the star-schema parquet files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import panel as P
from ..session import series_tasks, spread

# The pool has one column of scores per embedding dimension (schema-bound, not data-bound).
MODELS = [f"m{i}" for i in range(64)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def _readings(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The readings, and the number of tasks for work on the days of each series."""
    t = table(spark, sf, "lineitem")
    n = series_tasks(t)
    return (t.select(F.col("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("dt"), "l_quantity")
            .groupBy("series_id", "dt").agg(F.sum("l_quantity").alias("value"))), n


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """series_id, dt, value: shipped quantity per supplier and day."""
    return _readings(spark, sf)[0]


def panel(spark: SparkSession, sf: str, neighbours: bool = False) -> DataFrame:
    r, n = _readings(spark, sf)
    return P.densify(r, neighbours=neighbours, tasks=n)


def filled(spark: SparkSession, sf: str) -> DataFrame:
    """Panel with column f = value, 0 where missing."""
    return panel(spark, sf).withColumn("f", F.coalesce("value", F.lit(0.0)))


def observed(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    """Readings that exist (of those that match), with the position among the observed days of the series."""
    r, n = _readings(spark, sf)
    return P.observed_positions(r.where(where), tasks=n)


def totals(spark: SparkSession, sf: str) -> DataFrame:
    """series_id, total, cents: total quantity per series."""
    return (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("series_id"))
            .agg(F.sum("l_quantity").alias("total")))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def score_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """id, y, p: ARRAY<DOUBLE> of 64 scores in (0,1)."""
    e = embeddings(spark, sf)
    p = F.transform("embedding", lambda x: 1.0 / (1.0 + F.exp(-5.0 * x.cast("double"))))
    return e.select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("y"), p.alias("p"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Long form: id, y, model, p."""
    m = score_matrix(spark, sf)
    return m.select("id", "y", F.posexplode("p").alias("k", "p")).select(
        "id", "y", F.concat(F.lit("m"), F.col("k")).alias("model"), "p")


def wide_scores(spark: SparkSession, sf: str, models: list[int]) -> DataFrame:
    m = score_matrix(spark, sf)
    return m.select("id", "y", *[F.get("p", F.lit(i)).alias(f"m{i}") for i in models])


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def label_versions(spark: SparkSession, sf: str) -> DataFrame:
    """id, version, label: two label versions of the same items."""
    lab = table(spark, sf, "labels")
    return lab.select(F.col("doc_id").alias("id"), F.explode(F.array(
        F.struct(F.lit("original").alias("version"), F.col("quality").alias("label")),
        F.struct(F.lit("alternate").alias("version"), (1 - F.col("toxic")).alias("label")))).alias("s")) \
        .select("id", "s.version", "s.label")
