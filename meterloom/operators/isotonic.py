"""Isotonic calibration of scores from any number of rows.

The rising step function nearest to the labels has as its steps the slopes of the lower hull of (rows so far, positives so
far) in order of score, and hulls merge by ranges: pooling adjacent violators needs no place where all blocks meet. Between
steps the function is linear, outside of the known scores it is level, as is usual.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .hulls import lower_hull
from .ranking import running_totals

BUCKET_ROWS, MOST_BUCKETS = 200_000, 4096


def steps(df: DataFrame, by: list[str], score: str = "p", label: str = "y") -> DataFrame:
    """by, lo, hi, value: the steps of the fitted function of every group, from the least to the greatest score of each.
    Equal scores are pooled first; rows without a score are left out."""
    t = running_totals(df, score, {"a": F.col(label).cast("bigint"), "n": F.lit(1).cast("bigint")}, by=by)
    t = cut_lineage(t.select(*by, F.col("key").cast("double").alias("hi"), F.col("n_before").alias("from"), (F.col("n_before") + F.col("n")).alias("to"), (F.col("a_before") + F.col("a")).alias("a")))
    start = t.where(F.col("from") == 0).select(*by, F.lit(None).cast("double").alias("hi"), F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("a"))
    corners = lower_hull(t.select(*by, "hi", "to", "a").unionByName(start), by, "to", "a")
    w = W.partitionBy(*by).orderBy("to")
    blocks = corners.select(*by, "hi", F.lag("to").over(w).alias("from"), ((F.col("a") - F.lag("a").over(w)) / (F.col("to") - F.lag("to").over(w))).alias("value")).where("from is not null")
    return blocks.join(t.select(*by, "from", F.col("hi").alias("lo")), [*by, "from"]).select(*by, "lo", "hi", "value")


def interpolated(rows: DataFrame, knots: DataFrame, by: list[str], x: str = "p", out: str = "value") -> DataFrame:
    """`rows` with the value of the knots (by, x, value) at column `x`: linear between knots, level outside, null without
    any. Both are cut into value ranges, so no group is sorted as a whole; the knots next to a range are carried into it."""
    count = rows.count()
    parts = min(MOST_BUCKETS, max(8, count // BUCKET_ROWS))
    cuts = rows.select(F.percentile_approx(x, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    events = rows.withColumn("_knot", F.lit(None).cast("struct<x:double,value:double>")).unionByName(
        knots.select(*by, F.col("x").alias(x), F.struct("x", "value").alias("_knot")), allowMissingColumns=True)
    events = events.withColumn("_b", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(x))))
    held = events.groupBy(*by, "_b").agg(F.min("_knot").alias("_lo"), F.max("_knot").alias("_hi"))  # a row for each group and range
    up, down = (W.partitionBy(*by).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("_b"), F.desc("_b")))
    held = held.select(*by, "_b", F.last("_hi", ignorenulls=True).over(up).alias("_under"), F.last("_lo", ignorenulls=True).over(down).alias("_over"))
    inside = [W.partitionBy(*by, "_b").orderBy(o, F.col("_knot").isNull()).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc(x), F.desc(x))]
    seen = events.select("*", *[F.last("_knot", ignorenulls=True).over(w).alias(c) for w, c in zip(inside, ("_left", "_right"))])
    seen = seen.where(F.col("_knot").isNull()).join(held, [*by, "_b"])
    a, b = F.coalesce("_left", "_under"), F.coalesce("_right", "_over")
    seen = seen.withColumns({"_a": F.coalesce(a, b), "_z": F.coalesce(b, a)})
    share = F.when(F.col("_z.x") > F.col("_a.x"), (F.col(x) - F.col("_a.x")) / (F.col("_z.x") - F.col("_a.x"))).otherwise(0.0)
    return seen.withColumn(out, F.col("_a.value") + share * (F.col("_z.value") - F.col("_a.value"))).select(*rows.columns, out)


def calibrated(scored: DataFrame, folds: int, id_col: str = "id") -> DataFrame:
    """id, y, fold, raw, p: each score through the function fitted on the other folds. scored: id, y, fold, p."""
    x = scored.select(id_col, "y", "fold", F.col("p").cast("double").alias("p"))
    train = x.select("y", "p", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))).alias("model"))
    s = cut_lineage(steps(train, ["model"]))
    knots = s.select("model", F.col("lo").alias("x"), "value").union(s.where("hi > lo").select("model", "hi", "value"))
    out = interpolated(x.withColumn("model", F.col("fold")), knots, ["model"])
    return out.select(id_col, "y", "fold", F.col("p").alias("raw"), F.col("value").alias("p"))
