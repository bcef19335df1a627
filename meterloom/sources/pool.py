"""Pools of out-of-fold scores and label versions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def read_pool(scores: DataFrame, ids: DataFrame, allowed: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Scores of the allowed models that cover every id; others are rejected as a whole."""
    s = scores if allowed is None else scores.where(F.col("model").isin(allowed))
    n = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    full = s.groupBy("model").agg(F.count_distinct("id").alias("c")).where(F.col("c") == n).select("model")
    return s.join(full, "model", "left_semi").withColumn("model", F.concat(F.lit(prefix), "model"))


def discover(raw: DataFrame, n: Column, extra: tuple[str, ...] = ("prior",), bound: float = 10.0) -> DataFrame:
    """Keys that look like out-of-fold scores: named so, of full length and within +-bound."""
    named = raw.where(F.contains(F.lower("key"), F.lit("oof")) | F.col("key").isin(*extra))
    stats = named.groupBy("key").agg(F.count(F.lit(1)).alias("n_ids"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    return stats.where((F.col("n_ids") == n) & (F.col("hi") <= bound) & (F.col("lo") >= -bound))


def include(scores: DataFrame, parts: list[str]) -> DataFrame:
    return scores.where(reduce(lambda a, b: a | b, [F.contains("model", F.lit(p)) for p in parts]))


def choose_labels(versions: DataFrame, preference: list[str]) -> DataFrame:
    """The first available version of each id, in order of preference."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("version"))
    best = versions.where(rank > 0).groupBy("id").agg(F.min_by(F.struct("label", "version"), rank).alias("b"))
    return best.select("id", F.col("b.label").alias("label"), F.col("b.version").alias("source"))


def version_diff(versions: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of ids whose two label versions disagree."""
    pick = [F.max(F.when(F.col("version") == v, F.col("label"))).alias(v) for v in (a, b)]
    w = versions.groupBy("id").agg(*pick)
    return w.where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
