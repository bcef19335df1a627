"""Local peaks with a minimum distance, as windows over each series.

A plateau higher than both sides is one peak at its middle. Of peaks closer than the distance the higher one stays, the later
one of equal ones: in rounds, a peak above all undecided ones within the distance stays and those near it go.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .panel import ID

KEYS = [ID, "side"]


def local_peaks(obs: DataFrame, value: str = "value", order: str = "pos", distance: int = 7) -> DataFrame:
    """ID, side (1 peaks, -1 valleys), at: the peaks that stay."""
    both = obs.select(ID, F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"), F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("v"))
    x = both.withColumn("v", F.col("v") * F.col("side"))
    w = W.partitionBy(*KEYS).orderBy("at")
    x = x.withColumn("new", F.coalesce((F.col("v") != F.lag("v").over(w)).cast("int"), F.lit(1)))
    runs = x.withColumn("run", F.sum("new").over(w)).groupBy(*KEYS, "run").agg(F.first("v").alias("v"), F.min("at").alias("a"), F.max("at").alias("z"))
    near = W.partitionBy(*KEYS).orderBy("run")
    top = runs.withColumns({"before": F.lag("v").over(near), "after": F.lead("v").over(near)}).where("v > before and v > after")
    left = cut_lineage(top.select(*KEYS, F.floor((F.col("a") + F.col("z")) / 2).alias("at"), "v", F.lit(False).alias("stays")))
    around = W.partitionBy(*KEYS).orderBy("at").rangeBetween(-(distance - 1), distance - 1)
    while not left.where("not stays").isEmpty():
        undecided = F.when(~F.col("stays"), F.struct("v", "at"))
        kept = left.withColumn("stays", F.col("stays") | (F.max(undecided).over(around) == F.struct("v", "at")))
        left = cut_lineage(kept.withColumn("near", F.max("stays").over(around)).where("stays or not near").drop("near"))
    return left.select(*KEYS, "at")


def peak_features(obs: DataFrame, value: str = "value", order: str = "pos", distance: int = 7) -> DataFrame:
    found = local_peaks(obs, value, order, distance).groupBy(ID).agg(F.count_if(F.col("side") == 1).alias("up"), F.count_if(F.col("side") == -1).alias("down"))
    n = obs.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).join(found, ID, "left")
    up = F.coalesce("up", F.lit(0))
    return n.select(ID, up.cast("int").alias("n_peaks"), F.coalesce("down", F.lit(0)).cast("int").alias("n_valleys"), (up / (F.col("n") + 1e-8)).alias("peak_ratio"))
