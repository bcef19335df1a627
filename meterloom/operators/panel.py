"""Dense panels: one row per series and calendar day, with explicit missingness.

Every per-series window below works on at most one row per calendar day (readings are summed per series and
day first, with map-side combine), so a series that holds a third of the raw rows still makes a small group.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

ID, DAY = "series_id", "day_idx"


def by_day(*cols: str):
    return W.partitionBy(ID).orderBy(*(cols or (DAY,)))


def whole() -> W:
    return W.partitionBy(ID)


def span(readings: DataFrame, date_col: str = "dt"):
    """Scalar struct (lo, hi) of the calendar."""
    return readings.agg(F.struct(F.min(date_col).alias("lo"), F.max(date_col).alias("hi")).alias("s")).scalar()


def dealt(df: DataFrame, tasks: int | None) -> DataFrame:
    """Whole series dealt into a number of tasks that adaptive execution keeps: it would join them by their sparse bytes,
    but memory follows the dense rows. None: left to the session."""
    return df.repartition(tasks, ID) if tasks else df


def densify(readings: DataFrame, date_col: str = "dt", value_col: str = "value", neighbours: bool = False, tasks: int | None = None) -> DataFrame:
    """ids x days without a join: each observed day also emits the empty days up to the next observed one.

    One shuffle by series; the rows stay partitioned by series, so later per-series windows add no shuffle.
    neighbours: also carry _b and _n, the last observed (p, v) up to the day and the first one from the day on; they
    come from the sparse rows in the same sort, so interpolation needs no window over the dense rows.
    """
    return _emit_days(dealt(_indexed(readings, date_col).withColumnRenamed(value_col, "_v"), tasks), neighbours)


def _indexed(readings: DataFrame, date_col: str) -> DataFrame:
    return (readings.withColumn("_s", span(readings, date_col)).withColumn("_d", F.datediff(date_col, F.col("_s.lo")))
            .withColumn("n_days", F.datediff(F.col("_s.hi"), F.col("_s.lo")) + 1).withColumn("_lo", F.col("_s.lo")))


def _emit_days(r: DataFrame, neighbours: bool, seen=None, pos: str = "_d") -> DataFrame:
    """Sparse rows (series_id, _d, _v, n_days, _lo) to dense rows. `seen` marks the rows that count as neighbours."""
    w = by_day("_d")
    r = (r.withColumn("_next", F.coalesce(F.lead("_d").over(w), F.col("n_days")))
         .withColumn("_from", F.when(F.lag("_d").over(w).isNull(), F.lit(0)).otherwise(F.col("_d"))))
    extra = []
    if neighbours:
        ok = F.col("_v").isNotNull() if seen is None else F.col("_v").isNotNull() & seen
        r = r.withColumn("_self", F.when(ok, F.struct(F.col(pos).alias("p"), F.col("_v").alias("v"))))
        r = r.withColumn("_prev", F.last("_self", True).over(w.rowsBetween(W.unboundedPreceding, 0))) \
            .withColumn("_later", F.expr(f"lead(_self, 1) ignore nulls over (partition by {ID} order by _d)"))
        extra = ["_self", "_prev", "_later"]
    d = r.select(ID, "n_days", "_lo", "_d", "_v", *extra, F.explode(F.sequence(F.col("_from"), F.col("_next") - 1)).alias(DAY))
    here = F.col(DAY) == F.col("_d")
    value = F.when(here, F.col("_v"))
    out = [ID, DAY, F.date_add("_lo", F.col(DAY)).alias("dt"), value.alias("value"), value.isNull().alias("is_missing"), "n_days"]
    if neighbours:
        before = F.col(DAY) < F.col("_d")  # only ahead of the first observed row
        out += [F.when(~before, F.col("_prev")).alias("_b"),
                F.when(here, F.coalesce("_self", "_later")).when(before, F.coalesce("_self", "_later")).otherwise(F.col("_later")).alias("_n")]
    return d.select(*out)


def with_day_index(readings: DataFrame, date_col: str = "dt") -> DataFrame:
    """Observed rows with the day_idx they have in the panel; no shuffle, for statistics that ignore missing days."""
    r = readings.withColumn("_s", span(readings, date_col))
    return r.withColumn(DAY, F.datediff(date_col, F.col("_s.lo"))).drop("_s")


def observed_positions(readings: DataFrame, date_col: str = "dt", tasks: int | None = None) -> DataFrame:
    """Observed readings with pos = 0..n-1 in time order and n = number observed."""
    return (dealt(readings.where("value is not null"), tasks)
            .withColumn("pos", F.row_number().over(W.partitionBy(ID).orderBy(date_col)) - 1)
            .withColumn("n", F.count(F.lit(1)).over(whole())))


def series_arrays(df: DataFrame, value_col: str, order_col: str = DAY) -> DataFrame:
    """One row per series: x = ARRAY<DOUBLE> in time order (length bounded by the calendar)."""
    return (df.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct(order_col, value_col))).alias("_a"))
            .select(ID, F.transform("_a", lambda e: e[value_col].cast("double")).alias("x")))


def moving_average(value: str, width: int, order_col: str = DAY, n_col: str = "n_days"):
    """Centred moving average whose frame slots outside the series repeat the end values.

    An even width covers [-width/2, width/2 - 1].
    """
    left, right = width // 2, width - width // 2 - 1
    w = by_day(order_col)
    inside = F.sum(value).over(w.rowsBetween(-left, right))
    miss_l = F.greatest(F.lit(left) - F.col(order_col), F.lit(0))
    miss_r = F.greatest(F.col(order_col) + right - (F.col(n_col) - 1), F.lit(0))
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (inside + miss_l * F.first(value).over(full) + miss_r * F.last(value).over(full)) / F.lit(float(width))


def moving_average_mirrored(df: DataFrame, value: str, width: int, out: str) -> DataFrame:
    """Centred moving average with the series mirrored at both ends (d c b a | a b c d | d c b a)."""
    left, right = width // 2, width - width // 2 - 1
    n, d = F.col("n_days"), F.col(DAY)
    images = F.array_compact(F.array(
        F.struct(d.alias("_p"), F.lit(True).alias("_real")),
        F.when(d < left, F.struct((-1 - d).alias("_p"), F.lit(False).alias("_real"))),
        F.when(d >= n - right, F.struct((2 * n - 1 - d).alias("_p"), F.lit(False).alias("_real")))))
    w = W.partitionBy(ID).orderBy("_p").rowsBetween(-left, right)
    return (df.withColumn("_i", F.explode(images)).select(*df.columns, "_i._p", "_i._real")
            .withColumn(out, F.avg(value).over(w)).where("_real").drop("_p", "_real"))
