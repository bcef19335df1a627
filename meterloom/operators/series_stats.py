"""Per-series aggregate features. Inputs: a dense panel with column f (filled), or observed readings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import avg_if, clip, col, share
from .clean import tier_bounds, tier_of
from .panel import DAY, ID, by_day, whole
from .runs import run_stats

EPS = 1e-8
PCTS = (1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95, 99)


def nz(c: Column, d: float = 0.0) -> Column:
    """NULL and NaN become the default."""
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(float(d)))


def safe_corr(a, b) -> Column:
    """Pearson correlation over the rows where both are present; 0 when either side is constant."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    sd = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.coalesce(F.try_divide(F.covar_pop(a.cast("double"), b.cast("double")), sd), F.lit(0.0))


def pct(value: str, *ps: float) -> Column:
    return F.percentile(value, [float(p) for p in ps])


def basic(obs: DataFrame, v: str = "value") -> DataFrame:
    x = obs.withColumn("_med", F.median(v).over(whole()))
    g = x.groupBy(ID).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var"),
                          F.first("_med").alias("median"), F.avg(F.abs(F.col(v) - F.col("_med"))).alias("mad"),
                          pct(v, .25, .75).alias("_q"), F.max(v).alias("max"), F.min(v).alias("min"))
    return g.select(ID, "mean", "std", "var", clip(F.col("std") / (F.col("mean") + EPS), 0, 20).alias("cv"), "median", "mad",
                    (F.col("max") - F.col("min")).alias("range"), (F.col("_q")[1] - F.col("_q")[0]).alias("iqr"), "max", "min",
                    (F.col("max") / (F.col("mean") + EPS)).alias("max_mean_ratio"),
                    (F.col("min") / (F.col("mean") + EPS)).alias("min_mean_ratio"),
                    (F.col("max") / (F.col("min") + EPS)).alias("max_min_ratio"))


def percentiles(obs: DataFrame, v: str = "value", ps: tuple[int, ...] = PCTS) -> DataFrame:
    g = obs.groupBy(ID).agg(pct(v, *[p / 100 for p in ps]).alias("_q"))
    g = g.select(ID, *[F.col("_q")[i].alias(f"q{p}") for i, p in enumerate(ps)])
    if set(ps) >= {5, 10, 25, 50, 75, 90, 95}:
        g = g.select("*", (F.col("q95") / (F.col("q5") + EPS)).alias("q95_q05"), (F.col("q90") / (F.col("q10") + EPS)).alias("q90_q10"),
                     (F.col("q50") - F.col("q25")).alias("q50_q25"), (F.col("q75") - F.col("q50")).alias("q75_q50"))
    return g


def moments(obs: DataFrame, v: str = "value") -> DataFrame:
    """Population skewness and excess kurtosis; too short or constant series give 0."""
    return obs.groupBy(ID).agg(F.when(F.count(v) > 2, nz(F.skewness(v))).otherwise(0.0).alias("skew"),
                               F.when(F.count(v) > 3, nz(F.kurtosis(v))).otherwise(0.0).alias("kurt"))


def threshold_ratios(obs: DataFrame, v: str = "value", above=(10, 20, 30, 50, 100), below=(5, 10, 20)) -> DataFrame:
    return obs.groupBy(ID).agg(*[share(F.col(v) > t).alias(f"above_{t}") for t in above],
                               *[share(F.col(v) < t).alias(f"below_{t}") for t in below])


def tail_means(obs: DataFrame, v: str = "value") -> DataFrame:
    x = obs.withColumn("_q", pct(v, .05, .95).over(whole()))
    return x.groupBy(ID).agg(avg_if(v, F.col(v) >= F.col("_q")[1]).alias("top5_mean"), avg_if(v, F.col(v) <= F.col("_q")[0]).alias("bottom5_mean"))


def differences(df: DataFrame, v: str = "value", order: str = "pos") -> DataFrame:
    w = by_day(order)
    x = df.withColumn("_d", F.col(v) - F.lag(v).over(w)).withColumn("_s", F.signum("_d"))
    x = x.withColumn("_ch", (F.col("_s") != F.lag("_s").over(w)).cast("int"))
    g = x.groupBy(ID).agg(F.count("_d").alias("_n"), F.avg("_d").alias("diff_mean"), F.stddev_pop("_d").alias("diff_std"),
                          F.avg(F.abs("_d")).alias("diff_abs_mean"), F.max(F.abs("_d")).alias("diff_abs_max"),
                          F.percentile(F.abs("_d"), [.75, .9]).alias("_q"), F.sum("_ch").alias("_c"),
                          F.avg((F.col("_d") > 0).cast("double")).alias("_p"))
    cols = {c: F.col(c) for c in ("diff_mean", "diff_std", "diff_abs_mean", "diff_abs_max")}
    cols |= {"diff_q75": F.col("_q")[0], "diff_q90": F.col("_q")[1], "sign_change_ratio": F.col("_c") / (F.col("_n") + EPS),
             "positive_ratio": F.col("_p"), "negative_ratio": 1 - F.col("_p")}
    return g.select(ID, *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in cols.items()])


def trend(obs: DataFrame, v: str = "value") -> DataFrame:
    """Slope, r2, standard error, slopes of the three thirds and the change of the 7-point end means."""
    p, n = F.col("pos"), F.col("n")
    third = F.when(p < F.floor(n / 3), 1).when(p < F.floor(2 * n / 3), 2).otherwise(3)
    x = obs.withColumn("_t", third)

    def sl(k):
        c = F.col("_t") == k
        return F.when(F.count(F.when(c, 1)) > 5, F.regr_slope(F.when(c, F.col(v)), F.when(c, p)))

    g = x.groupBy(ID).agg(F.first("n").alias("n"), F.regr_slope(v, "pos").alias("slope"), F.regr_r2(v, "pos").alias("_r2"),
                          F.regr_sxx(v, "pos").alias("_sxx"), F.regr_syy(v, "pos").alias("_syy"),
                          sl(1).alias("s1"), sl(2).alias("s2"), sl(3).alias("s3"),
                          avg_if(v, p >= n - 7).alias("last"), avg_if(v, p < 7).alias("first"))
    r2 = F.when(F.col("_syy") > 0, F.col("_r2")).otherwise(0.0)
    three = F.col("s1").isNotNull() & F.col("s2").isNotNull() & F.col("s3").isNotNull()
    cols = {"slope": F.col("slope"), "r2": r2, "std_err": F.sqrt((1 - r2) * F.col("_syy") / F.col("_sxx") / (F.col("n") - 2)),
            "slope_first": F.when(three, F.col("s1")), "slope_mid": F.when(three, F.col("s2")),
            "slope_last": F.when(three, F.col("s3")), "acceleration": F.when(three, F.col("s3") - F.col("s1")),
            "mean_first7": F.col("first"), "mean_last7": F.col("last"), "mean_change7": F.col("last") - F.col("first")}
    return g.select(ID, *[F.coalesce(F.when(F.col("n") > 30, c), F.lit(0.0)).alias(k) for k, c in cols.items()])


def zero_missing(df: DataFrame, f: str = "f") -> DataFrame:
    g = df.groupBy(ID).agg(share(F.col(f) == 0).alias("zero_ratio"), share(F.col(f) < 1).alias("below_1_ratio"),
                           share(F.col("is_missing")).alias("missing_ratio"))
    gaps = run_stats(df, F.col("is_missing"), prefix="gap").drop("gap_mean")
    zeros = run_stats(df, F.col(f) == 0, prefix="zero").drop("zero_mean", "zero_count")
    return g.join(gaps, ID).join(zeros, ID)


def recent(df: DataFrame, v: str = "f", days=(7, 14, 30, 60)) -> DataFrame:
    aggs = []
    for d in days:
        x = F.when(F.col(DAY) >= F.col("n_days") - d, F.col(v))
        aggs += [F.avg(x).alias(f"mean_{d}"), F.stddev_pop(x).alias(f"std_{d}"), F.max(x).alias(f"max_{d}"),
                 F.min(x).alias(f"min_{d}"), (F.max(x) - F.min(x)).alias(f"range_{d}")]
    return df.groupBy(ID).agg(*aggs)


def holidays(df: DataFrame, f: str = "f") -> DataFrame:
    """Spring window Jan 28 - Feb 15, national window Oct 1 - 7, reference window Jan 1 - 25."""
    m, d = F.month("dt"), F.dayofmonth("dt")
    spring = ((m == 1) & (d >= 28)) | ((m == 2) & (d <= 15))
    nat = (m == 10) & (d <= 7)
    pos = F.col(f) > 0

    def zr(c):
        return F.coalesce(F.avg(F.when(c, (F.col(f) == 0).cast("double"))), F.lit(0.0))

    def pm(c, default=0.0):
        return F.coalesce(avg_if(f, c & pos), F.lit(float(default)))

    pre = (m == 1) & (d <= 25)
    g = df.groupBy(ID).agg(pm(spring).alias("spring_mean"), zr(spring).alias("spring_zero_ratio"), pm(pre, 1).alias("_pre"),
                           pm(nat).alias("national_mean"), zr(nat).alias("national_zero_ratio"),
                           zr(spring | nat).alias("holiday_zero_ratio"), pm(spring | nat).alias("holiday_mean"))
    return g.withColumn("spring_ratio", F.col("spring_mean") / (F.col("_pre") + EPS)).drop("_pre")


def monthly_means(df: DataFrame, v: str = "value") -> DataFrame:
    """Mean per calendar month (1-12) and its ratio to the mean of the positive monthly means."""
    g = df.groupBy(ID).agg(*[F.coalesce(avg_if(v, F.month("dt") == m), F.lit(0.0)).alias(f"month_{m}") for m in range(1, 13)])
    pos = F.filter(F.array(*[F.col(f"month_{m}") for m in range(1, 13)]), lambda x: x > 0)
    overall = F.when(F.size(pos) > 0, F.aggregate(pos, F.lit(0.0), lambda a, x: a + x) / F.size(pos)).otherwise(1.0)
    return g.withColumn("_o", overall).select(ID, *[f"month_{m}" for m in range(1, 13)], *[
        (F.col(f"month_{m}") / (F.col("_o") + EPS)).alias(f"month_ratio_{m}") for m in range(1, 13)])


def monthly_cv(df: DataFrame, v: str = "f", eps: float = EPS) -> DataFrame:
    m = df.where(F.col(v).isNotNull()).groupBy(ID, F.month("dt").alias("_m")).agg(
        F.count(F.lit(1)).alias("_n"), (F.stddev_pop(v) / (F.avg(v) + eps)).alias("_cv")).where("_n > 1")
    return m.groupBy(ID).agg(F.avg("_cv").alias("monthly_cv_mean"), F.stddev_pop("_cv").alias("monthly_cv_std"))


def weekday_ratio(df: DataFrame, v: str = "f") -> DataFrame:
    wd = F.weekday("dt")
    return df.groupBy(ID).agg(F.coalesce(avg_if(v, wd < 5) / (avg_if(v, wd >= 5) + EPS), F.lit(1.0)).alias("weekday_weekend_ratio"))


def absolute_deviation(obs: DataFrame, v: str = "value") -> DataFrame:
    x = obs.withColumn("_a", F.abs(F.col(v) - F.avg(v).over(whole())))
    return x.groupBy(ID).agg(F.max("_a").alias("abs_dev_max"), F.avg("_a").alias("abs_dev_mean"))


def autocorrelation(df: DataFrame, v: str = "value", order: str = "pos", lags=(1, 7, 30), min_extra: int | None = None) -> DataFrame:
    """Pearson correlation of the series with itself shifted by k positions; 0 when undefined or too short."""
    w = by_day(order)
    x = df.select(ID, order, v, *[F.lag(v, k).over(w).alias(f"_l{k}") for k in lags])
    out = []
    for k in lags:
        guard = F.count(v) >= k + min_extra if min_extra is not None else F.count(v) > max(20, k)
        out.append(F.when(guard, safe_corr(v, f"_l{k}")).otherwise(0.0).alias(f"autocorr_{k}"))
    return x.groupBy(ID).agg(*out)


def autocovariance_ratio(df: DataFrame, v: str = "f", lags=(1, 7, 30), eps: float = 1e-12) -> DataFrame:
    x = df.withColumn("_m", F.col(v) - F.avg(v).over(whole()))
    w = by_day()
    x = x.select(ID, "_m", *[F.lag("_m", k).over(w).alias(f"_l{k}") for k in lags])
    return x.groupBy(ID).agg(*[(F.avg(F.col("_m") * F.col(f"_l{k}")) / (F.avg(F.col("_m") * F.col("_m")) + eps)).alias(f"acov_{k}") for k in lags])


def regularity_flags(obs: DataFrame, v: str = "value", order: str = "pos") -> DataFrame:
    """1/std of differences, share of differences beyond 3 deviations, share of days below the P10."""
    w = whole()
    x = obs.withColumn("_d", F.col(v) - F.lag(v).over(by_day(order)))
    x = x.withColumn("_dm", F.avg("_d").over(w)).withColumn("_ds", F.stddev_pop("_d").over(w)).withColumn("_p", pct(v, .1).over(w)[0])
    g = x.groupBy(ID).agg(F.count(v).alias("_n"), (1.0 / (F.first("_ds") + EPS)).alias("flatness"),
                          F.avg((F.abs(F.col("_d") - F.col("_dm")) > 3 * (F.col("_ds") + EPS)).cast("double")).alias("sudden_change_ratio"),
                          F.sum((F.col(v) < F.col("_p")).cast("int")).alias("_low"))
    ok = F.col("_n") > 10
    return g.select(ID, F.when(ok, F.col("flatness")).otherwise(0.0).alias("flatness"), F.when(ok, F.col("sudden_change_ratio")).otherwise(0.0).alias("sudden_change_ratio"),
                    F.when(ok, F.col("_low") / (F.col("_n") + EPS)).otherwise(0.0).alias("low_day_ratio"))


def month_extremes(df: DataFrame, v: str = "value") -> DataFrame:
    m = df.where(F.col(v).isNotNull()).groupBy(ID, F.month("dt").alias("_m")).agg(F.avg(v).alias("_a"))
    g = m.groupBy(ID).agg(F.count(F.lit(1)).alias("_n"), (F.max("_a") / (F.min("_a") + EPS)).alias("_r"), (F.stddev_pop("_a") / (F.avg("_a") + EPS)).alias("_s"))
    return g.select(ID, F.when(F.col("_n") > 3, F.col("_r")).otherwise(1.0).alias("monthly_max_min_ratio"), F.when(F.col("_n") > 3, F.col("_s")).otherwise(0.0).alias("monthly_std_norm"))


def zero_runs(df: DataFrame, f: str = "f") -> DataFrame:
    z = run_stats(df, F.col(f) == 0, prefix="zero_run").drop("zero_run_mean")
    return z.join(month_extremes(df), ID, "left")


def tiers(means: DataFrame, fit: DataFrame | None = None, m: str = "m") -> DataFrame:
    """Consumption tier 0-5 and its one-hot columns; bounds come from `fit` (default: the same rows)."""
    t = means.withColumn("_t", tier_bounds(fit if fit is not None else means, m)).select(ID, m, tier_of(F.col(m), "_t").alias("tier"))
    return t.select("*", *[(F.col("tier") == k).cast("int").alias(f"tier_{k}") for k in range(1, 6)])


def yearly_drift(df: DataFrame, v: str = "value") -> DataFrame:
    """Per calendar month: CV, relative slope and largest relative drop of the yearly means (long form)."""
    y = df.where(F.col(v).isNotNull()).groupBy(ID, F.month("dt").alias("month"), F.year("dt").alias("_y")).agg(
        F.avg(v).alias("_m"), F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(ID, "month").orderBy("_y")
    y = y.withColumn("_r", F.row_number().over(w)).withColumn("_prev", F.lag("_m").over(w))
    g = y.groupBy(ID, "month").agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_n"), F.avg("_m").alias("_a"), F.stddev_pop("_m").alias("_s"),
                                   F.regr_slope("_m", "_r").alias("_b"), F.max((F.col("_prev") - F.col("_m")) / (F.col("_prev") + 1e-6)).alias("_d"))
    ok = (F.col("_c") >= 10) & (F.col("_n") >= 2)
    return g.select(ID, "month", F.when(ok & (F.col("_a") > 0.1), F.col("_s") / F.col("_a")).otherwise(0.0).alias("yoy_cv"),
                    F.when(ok & (F.col("_s") > 0), F.col("_b") / (F.col("_a") + 1e-6)).otherwise(0.0).alias("yoy_trend"),
                    F.when(ok, F.greatest(F.col("_d"), F.lit(0.0))).otherwise(0.0).alias("yoy_drop"))
