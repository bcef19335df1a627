"""Runs of a predicate along a series, and level-shift detection by cumulative sums."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .panel import DAY, ID, by_day, whole


def runs(df: DataFrame, pred: Column, order_col: str = DAY, keys: list[str] | None = None) -> DataFrame:
    """One row per maximal run of rows where `pred` holds: run, start, length (gaps and islands)."""
    keys = keys or [ID]
    w = W.partitionBy(*keys).orderBy(order_col)
    hit = F.coalesce(pred, F.lit(False))
    x = df.select(*keys, F.col(order_col).alias("_o"), hit.alias("_h"))
    w = W.partitionBy(*keys).orderBy("_o")
    x = x.withColumn("_s", (F.col("_h") & ~F.coalesce(F.lag("_h").over(w), F.lit(False))).cast("int"))
    x = x.withColumn("run", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (x.where("_h").groupBy(*keys, "run").agg(F.min("_o").alias("start"), F.count(F.lit(1)).alias("length")))


def run_stats(df: DataFrame, pred: Column, order_col: str = DAY, prefix: str = "run") -> DataFrame:
    """Per series: number, longest and mean length of runs; series without a run get zeros. One sort and one aggregate in
    the partitioning of the series: where a run ends, its length is the distance to the last row outside of runs."""
    w = W.partitionBy(ID).orderBy("_o")
    x = df.select(ID, F.col(order_col).alias("_o"), F.coalesce(pred, F.lit(False)).alias("_h"))
    x = x.withColumns({"_r": F.row_number().over(w), "_next": F.lead("_h").over(w)})
    x = x.withColumn("_out", F.max(F.when(~F.col("_h"), F.col("_r"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    length = F.when(F.col("_h") & ~F.coalesce("_next", F.lit(False)), (F.col("_r") - F.coalesce("_out", F.lit(0))).cast("bigint"))
    return x.groupBy(ID).agg(F.count(length).alias(f"{prefix}_count"), F.coalesce(F.max(length), F.lit(0).cast("bigint")).alias(f"{prefix}_longest"),
                             F.coalesce(F.avg(length), F.lit(0.0)).alias(f"{prefix}_mean"))


def run_length_buckets(df: DataFrame, pred: Column, edges: tuple[int, ...] = (5, 60, 200),
                       names: tuple[str, ...] = ("short", "medium", "long", "extreme")) -> DataFrame:
    """Distribution of run lengths over buckets (right-closed edges)."""
    r = runs(df, pred)
    b = F.lit(names[-1])
    for e, n in reversed(list(zip(edges, names))):
        b = F.when(F.col("length") <= e, n).otherwise(b)
    c = r.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # at most four rows


def run_flags(df: DataFrame, flag: str, order_col: str = DAY) -> DataFrame:
    """Adds run (id) and run_len for both values of `flag`: constant stretches."""
    w = W.partitionBy(ID).orderBy(order_col)
    ch = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(0))
    x = df.withColumn("_ch", ch).withColumn("run", F.sum("_ch").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.withColumn("run_len", F.count(F.lit(1)).over(W.partitionBy(ID, "run"))).drop("_ch")


def cusum_shift(df: DataFrame, value: str, valid: Column, order_col: str = DAY, n_col: str = "n_days",
                threshold: float = 3.0, drift: float = 0.2, min_segment: int = 30, reject_weak: bool = True,
                post_values: str | None = None, reference: int = 200) -> DataFrame:
    """Two-sided cumulative-sum level shift per series without recursion.

    The reflected walk S_t = max(0, S_{t-1} + a_t) equals C_t - min(0, min_{s<=t} C_s) with C the plain running
    sum of a_t, so two window sums and two window minima replace the loop. Reference level and scale come from
    the first min(n/2, reference) valid points. All in the partitioning of the series, without a join.
    """
    w = W.partitionBy(ID).orderBy("_o")
    up_to, every = w.rowsBetween(W.unboundedPreceding, 0), whole()
    x = df.select(ID, F.col(order_col).alias("_o"), F.col(n_col).alias("_t"), F.col(value).alias("_x"), F.col(post_values or value).alias("_v"), F.coalesce(valid, F.lit(False)).alias("_ok"))
    x = x.withColumn("_p", F.count_if("_ok").over(up_to) - 1).withColumn("_n", F.count_if("_ok").over(every))
    head = F.when(F.col("_ok") & (F.col("_p") < F.least(F.floor(F.col("_n") / 2), F.lit(reference))), F.col("_x"))
    x = x.withColumns({"_mu": F.avg(head).over(every), "_sd": F.stddev_pop(head).over(every) + 1e-6})
    k = drift * F.col("_sd")
    x = x.withColumns({"_cp": F.sum(F.when(F.col("_ok"), F.col("_x") - F.col("_mu") - k)).over(up_to), "_cn": F.sum(F.when(F.col("_ok"), F.col("_mu") - k - F.col("_x"))).over(up_to)})
    x = x.withColumns({"_lp": F.least(F.lit(0.0), F.min("_cp").over(up_to)), "_ln": F.least(F.lit(0.0), F.min("_cn").over(up_to))})
    h = threshold * F.col("_sd")
    x = x.withColumns({"_rise": F.min(F.when(F.col("_ok") & (F.col("_cp") - F.col("_lp") > h), F.col("_o"))).over(every),
                       "_drop": F.min(F.when(F.col("_ok") & (F.col("_cn") - F.col("_ln") > h), F.col("_o"))).over(every)})
    x = x.select(ID, "_o", "_t", "_v", "_n", F.least("_rise", "_drop").alias("_at"), (F.col("_drop").isNotNull() & (F.col("_rise").isNull() | (F.col("_drop") <= F.col("_rise")))).alias("_down"))
    before = F.col("_o") < F.col("_at")
    x = x.withColumns({"_pre": F.avg(F.when(before, F.col("_v"))).over(every), "_post": F.avg(F.when(~before, F.col("_v"))).over(every)})
    low = F.coalesce(F.col("_v") < F.col("_post") * 1.5, F.lit(False))
    m = x.groupBy(ID).agg(*[F.first(c).alias(c) for c in ("_n", "_t", "_at", "_down", "_pre", "_post")], F.avg(F.when(F.col("_o") >= F.col("_at"), low.cast("double"))).alias("_pers"))
    ratio = F.col("_post") / (F.col("_pre") + 1e-6)
    strong = F.when(F.col("_down"), ratio <= 0.95).otherwise(ratio >= 1.05) if reject_weak else F.lit(True)
    inside = (F.col("_at") >= min_segment) & (F.col("_at") <= F.col("_t") - min_segment)
    hit = F.coalesce((F.col("_n") >= 2 * min_segment) & F.col("_at").isNotNull() & inside & strong, F.lit(False))
    counts = hit & (F.col("_down") if reject_weak else F.lit(True))
    return m.select(ID, hit.cast("int").alias("has_cp"), F.when(hit, F.col("_at")).otherwise(-1).cast("int").alias("cp"), F.when(hit, F.col("_pre")).otherwise(0.0).alias("pre_mean"),
                    F.when(hit, F.col("_post")).otherwise(0.0).alias("post_mean"), F.when(hit, ratio).otherwise(1.0).alias("change_ratio"),
                    F.when(counts, F.col("_pers")).otherwise(0.0).alias("persistence"))


def with_cumulative_deviation(df: DataFrame, value: str, out: str = "cusum") -> DataFrame:
    x = df.withColumn("_m", F.avg(value).over(whole()))
    return x.withColumn(out, F.sum(F.col(value) - F.col("_m")).over(by_day().rowsBetween(W.unboundedPreceding, 0))).drop("_m")


def cumulative_deviation(df: DataFrame, value: str) -> DataFrame:
    """Running sum of deviations from the mean: max, min, range and the first day of the largest magnitude."""
    g = with_cumulative_deviation(df, value).groupBy(ID).agg(
        F.max("cusum").alias("cusum_max"), F.min("cusum").alias("cusum_min"),
        F.max_by(DAY, F.struct(F.round(F.abs("cusum"), 6), -F.col(DAY))).alias("peak_day"))
    return g.withColumn("cusum_range", F.col("cusum_max") - F.col("cusum_min"))
