"""Labels, stratified folds and splits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources import tables as T
from .ranking import exact_quantiles, running_totals


def label_top_share(df: DataFrame, value: str, q: float = 0.9) -> DataFrame:
    cut = exact_quantiles(df, value, {"q": q}).select("q").scalar()
    return df.withColumn("y", (F.col(value) >= cut).cast("int"))


def mixed(id_col: str, seed: int = 42) -> Column:
    """Integer mix of an id, the same in every SQL engine."""
    return (F.col(id_col).cast("bigint") * 7919 + seed) % 10007


def stratified_folds(df: DataFrame, k: int = 5, id_col: str = "series_id", label: str = "y", seed: int = 42) -> DataFrame:
    """fold = rank of the mixed id within the class, modulo k. The rank is distributed: a class may hold most rows."""
    key = F.struct(mixed(id_col, seed).alias("h"), F.col(id_col).alias("id"))
    r = running_totals(df, key, {"c": F.lit(1)}, by=[label], collapsed=True)
    return r.select(F.col("key.id").alias(id_col), label, (F.col("c_before") % k).cast("int").alias("fold"))


def series_labels(spark, sf) -> DataFrame:
    return label_top_share(T.totals(spark, sf), "total").select("series_id", "y")


def series_folds(spark, sf, k: int = 5) -> DataFrame:
    return stratified_folds(series_labels(spark, sf), k)
