"""Regularity, patches, calendar profiles, missingness profiles and risk features (dense panel with column f)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import avg_if, div, entropy_term, share
from . import clean as C
from .panel import DAY, ID, by_day, moving_average_mirrored, whole
from .ranking import counted_quantiles, exact_quantiles, global_quantiles, grouped_quantiles, mean_ranks
from .runs import run_stats, with_cumulative_deviation
from .series_stats import nz, pct, safe_corr


def histogram_entropy(df: DataFrame, v: str, bins: Column, keys: list[str]) -> DataFrame:
    """Entropy of an equal-width histogram of v between its own minimum and maximum, per `keys` (and bin count)."""
    w = W.partitionBy(*keys)
    x = df.withColumn("_bins", bins).withColumn("_lo", F.min(v).over(w)).withColumn("_hi", F.max(v).over(w))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(v) - F.col("_lo")) * F.col("_bins") / (F.col("_hi") - F.col("_lo"))),
                                                       F.col("_bins") - 1)).otherwise(0)
    c = x.groupBy(*keys, "_bins", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_c"))
    c = c.withColumn("_p", F.col("_c") / F.sum("_c").over(W.partitionBy(*keys, "_bins")))
    return c.groupBy(*keys, F.col("_bins").alias("bins")).agg(F.sum(entropy_term(F.col("_p"))).alias("entropy"), F.sum("_c").alias("n"))


def multiscale_regularity(df: DataFrame, v: str = "f") -> DataFrame:
    """Difference/level deviation, direction changes, histogram entropies, lag-1 correlation, run entropy, longest high run.

    One sort and one aggregate: cells of the histograms are counted as columns, and a run is known at its last day."""
    w, every = by_day(), whole()
    up_to = w.rowsBetween(W.unboundedPreceding, 0)
    x = df.select(ID, DAY, v).withColumns({"_l": F.lag(v).over(w), "_hi": F.col(v) > F.median(v).over(every), "_row": F.row_number().over(w),
                                           "_a": F.min(F.when(F.col(v) > 0, F.col(v))).over(every), "_z": F.max(F.when(F.col(v) > 0, F.col(v))).over(every)})
    x = x.withColumn("_d", F.col(v) - F.col("_l")).withColumn("_s", F.signum("_d"))
    x = x.withColumns({"_ch": (F.col("_s") != F.lag("_s").over(w)).cast("int"), "_new": F.coalesce(F.col("_hi") != F.lag("_hi").over(w), F.col("_row") == 1)})
    x = x.withColumns({"_first": F.last(F.when(F.col("_new"), F.struct("_row", "_hi")), True).over(up_to), "_end": F.coalesce(F.lead("_new").over(w), F.lit(True))})
    x = x.withColumn("_len", F.when(F.col("_end"), F.col("_row") - F.col("_first._row") + 1)).withColumns({
        "_nb": F.least(F.lit(10), F.size(F.collect_set("_len").over(every))), "_la": F.min("_len").over(every), "_lz": F.max("_len").over(every)})

    def cell(value: str, bins: Column, lo: str, hi: str) -> Column:
        return F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(value) - F.col(lo)) * bins / (F.col(hi) - F.col(lo))), bins - 1)).otherwise(0)

    scales = (5, 10, 20)
    x = x.withColumns({f"_c{k}": F.when(F.col(v) > 0, cell(v, F.lit(k), "_a", "_z")) for k in scales} | {"_cr": F.when(F.col("_end"), cell("_len", F.col("_nb"), "_la", "_lz"))})
    held = {f"_c{k}": k for k in scales} | {"_cr": 10}
    g = x.groupBy(ID).agg((F.stddev_pop("_d") / (F.stddev_pop(v) + 1e-6)).alias("diff_level_ratio"), (F.sum("_ch") / F.count(v)).alias("direction_changes"),
                          F.when(F.stddev_pop(v) > 1e-6, safe_corr(v, "_l")).otherwise(0.0).alias("acf1"), F.count("_c5").alias("_n"), F.count("_len").alias("_runs"),
                          F.max(F.when(F.col("_first._hi"), F.col("_len"))).alias("_longest"), F.sum("_len").alias("_t"),
                          *[F.array(*[F.count_if(F.col(c) == j) for j in range(bins)]).alias(c) for c, bins in held.items()])

    def entropy(c: str, n: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, k: s + F.when(k > 0, entropy_term(k / F.col(n))).otherwise(0.0))

    def known(e: Column) -> Column:  # rows without a series have no profile
        return F.coalesce(F.when(F.col(ID).isNotNull(), e), F.lit(0.0))

    return g.select(ID, "diff_level_ratio", "direction_changes", *[known(F.when(F.col("_n") >= 10, entropy(f"_c{k}", "_n") / F.log(F.lit(float(k))))).alias(f"entropy_{k}") for k in scales],
                    "acf1", known(entropy("_cr", "_runs")).alias("run_entropy"), known(F.col("_longest") / F.col("_t")).alias("longest_high_run"))


def patch_features(df: DataFrame, v: str = "f", length: int = 30, stride: int = 15) -> DataFrame:
    """Statistics of overlapping patches (values above 0.01, at least 3 per patch), then of the patch sequence."""
    d = F.col(DAY)
    last = F.floor((F.col("n_days") - length) / stride)
    hits = df.select(ID, v, F.explode(F.filter(F.array(F.floor(d / stride) - 1, F.floor(d / stride)), lambda k: (k >= 0) & (k <= last)
                                               & (d >= k * stride) & (d < k * stride + length))).alias("patch"))
    p = hits.where(F.col(v) > 0.01).groupBy(ID, "patch").agg(F.count(F.lit(1)).alias("_n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"),
                                                           F.max(v).alias("hi"), F.min(v).alias("lo")).where("_n >= 3")
    w = W.partitionBy(ID).orderBy("patch")
    p = p.withColumn("k", F.row_number().over(w) - 1).withColumn("np", F.count(F.lit(1)).over(whole())) \
        .withColumn("prev", F.lag("m").over(w)).withColumn("dm", F.col("m") - F.col("prev"))
    p = p.withColumn("sdd", F.stddev_pop("dm").over(whole()))
    early = F.col("k") < F.floor(F.col("np") / 2)
    g = p.groupBy(ID).agg(F.first("np").alias("np"), F.avg("m").alias("mean_of_means"), F.stddev_pop("m").alias("std_of_means"),
                          (F.max("m") / (F.min("m") + 1e-6)).alias("range_ratio"), F.avg("s").alias("mean_of_stds"), F.max("s").alias("max_std"),
                          F.regr_slope("m", "k").alias("patch_trend"), (F.max("m") - F.min("m")).alias("_r"),
                          (F.stddev_pop("dm") / (F.avg(F.abs("dm")) + 1e-6)).alias("adjacent_variability"),
                          F.sum((F.abs("dm") > 2 * F.col("sdd")).cast("int")).alias("jumps"), safe_corr("m", "prev").alias("adjacent_corr"),
                          F.max("hi").alias("_hi"), F.min("lo").alias("_lo"), F.max(F.col("hi") - F.col("lo")).alias("_sp"),
                          avg_if("m", early).alias("_e"), avg_if("m", ~early).alias("_l"), F.stddev_pop(F.when(early, F.col("m"))).alias("_es"),
                          F.stddev_pop(F.when(~early, F.col("m"))).alias("_ls"))
    tot = df.groupBy(ID).agg((F.avg(v) + 1e-6).alias("_g"))
    x = tot.join(g, ID, "left")
    gm, ok = F.col("_g"), F.col("np") >= 3
    cols = {c: F.col(c) for c in ("mean_of_means", "std_of_means", "range_ratio", "mean_of_stds", "max_std", "patch_trend")}
    cols |= {"spread": F.col("_r") / gm, "adjacent_variability": F.col("adjacent_variability"), "jumps": F.col("jumps").cast("double"), "adjacent_corr": F.col("adjacent_corr"),
             "max_over_mean": F.col("_hi") / gm, "min_over_mean": F.col("_lo") / gm, "max_range": F.col("_sp") / gm,
             "late_minus_early": (F.col("_l") - F.col("_e")) / gm, "late_early_std": F.col("_ls") / (F.col("_es") + 1e-6)}
    return x.select(ID, *[F.coalesce(F.when(ok, c), F.lit(0.0)).alias(n) for n, c in cols.items()])


def calendar_profile(df: DataFrame, v: str = "f") -> DataFrame:
    """Long form: 12 year-fraction bins, 7 positions in the week, seasonal offsets for periods 7/30/90."""
    d = F.col(DAY)
    kinds = [("month", F.floor(d % 365 * 12 / 365)), ("dow", d % 7), ("offset7", d % 7), ("offset30", d % 30), ("offset90", d % 90)]
    x = df.withColumn("_m", F.avg(v).over(whole())).select(ID, v, "_m", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), e.cast("int").alias("idx")) for k, e in kinds])).alias("g")).select(ID, v, "_m", "g.*")
    a = x.groupBy(ID, "kind", "idx").agg(F.avg(v).alias("a"), F.first("_m").alias("_m"))
    return a.select(ID, "kind", "idx", F.when(F.col("kind").startswith("offset"), F.col("a") - F.col("_m")).otherwise(F.col("a")).alias("value"))


def window_trends(df: DataFrame, v: str = "f", widths=(7, 14, 30, 60, 90)) -> DataFrame:
    """Relative change between the first and last w days, and the mean step inside the last w days."""
    d, n = F.col(DAY), F.col("n_days")
    aggs = []
    for w in widths:
        a, b = avg_if(v, d < w), avg_if(v, d >= n - w)
        aggs += [F.when(F.abs(a) > 1e-6, (b - a) / (F.abs(a) + 1e-6)).otherwise(0.0).alias(f"change_{w}"),
                 ((F.max(F.when(d == n - 1, F.col(v))) - F.max(F.when(d == n - w, F.col(v)))) / (w - 1)).alias(f"step_{w}")]
    return df.groupBy(ID).agg(*aggs)


def missing_profile(df: DataFrame) -> DataFrame:
    d, n, m = F.col(DAY), F.col("n_days"), F.col("is_missing").cast("int")
    x = df.withColumn("_p", F.lag(m).over(by_day()))
    g = x.groupBy(ID).agg(F.avg(m.cast("double")).alias("missing"), F.avg(1.0 - m).alias("observed"),
                          *[avg_if(m.cast("double"), (d >= F.floor(n * k / 4)) & (d < F.floor(n * (k + 1) / 4))).alias(f"quarter_{k + 1}") for k in range(4)],
                          *[avg_if(m.cast("double"), (d >= F.floor(n * k / 2)) & (d < F.floor(n * (k + 1) / 2))).alias(f"half_{k + 1}") for k in range(2)],
                          F.coalesce(div(F.sum(m * F.col("_p")), F.sum(m)), F.lit(0.0)).alias("persistence"))
    return g.join(run_stats(df, F.col("is_missing"), prefix="gap").select(ID, "gap_longest"), ID)


def residual_aggregates(res: DataFrame, r: str = "residual", last=(30, 60, 90, 180, 365)) -> DataFrame:
    d, n = F.col(DAY), F.col("n_days")
    h = F.floor(n / 2)
    ps = (5, 10, 25, 50, 75, 90, 95)
    g = res.groupBy(ID).agg(F.avg(r).alias("res_mean"), F.stddev_pop(r).alias("res_std"), F.avg(F.abs(r)).alias("res_abs_mean"), F.max(F.abs(r)).alias("res_abs_max"),
                            pct(r, *[p / 100 for p in ps]).alias("_q"), avg_if(r, d < h).alias("_a"), avg_if(r, d >= h).alias("_b"),
                            *[avg_if(F.abs(r), d >= n - w).alias(f"res_abs_last{w}") for w in last])
    chg = F.when(F.abs("_a") > 1e-6, (F.col("_b") - F.col("_a")) / (F.abs("_a") + 1e-6)).otherwise(0.0)
    return g.select(ID, "res_mean", "res_std", "res_abs_mean", "res_abs_max", *[F.col("_q")[i].alias(f"res_p{p}") for i, p in enumerate(ps)],
                    chg.alias("res_half_change"), *[f"res_abs_last{w}" for w in last])


def observed_trend(obs: DataFrame, v: str = "value", widths=(30, 60, 90, 180)) -> DataFrame:
    """(last w - first w observed) / first, 0 when fewer than 2w points."""
    out = []
    for w in widths:
        ok = F.col("n") >= 2 * w
        a = F.coalesce(avg_if(v, ok & (F.col("pos") < w)), F.lit(0.0))
        b = F.coalesce(avg_if(v, ok & (F.col("pos") >= F.col("n") - w)), F.lit(0.0))
        out.append(((b - a) / (F.abs(a) + 1e-6)).alias(f"trend_firstlast_{w}"))
    return obs.groupBy(ID).agg(*out)


def profile_strength(df: DataFrame, v: str = "value") -> DataFrame:
    """Deviation over the 7 positions of the week and 12 thirty-day bins of the year, empty bins counting 0."""
    d = F.col(DAY)
    dow = [F.coalesce(avg_if(v, d % 7 == k), F.lit(0.0)) for k in range(7)]
    mon = [F.coalesce(avg_if(v, F.floor(d % 365 / 30) == k), F.lit(0.0)) for k in range(12)]

    def sd(name, k):
        mean = F.aggregate(F.col(name), F.lit(0.0), lambda a, x: a + x) / k
        return F.sqrt(F.aggregate(F.transform(name, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / k)

    g = df.groupBy(ID).agg(F.array(*dow).alias("_d"), F.array(*mon).alias("_m"))
    return g.select(ID, sd("_d", 7).alias("dow_profile_std"), sd("_m", 12).alias("month_profile_std"))


def low_usage_features(df: DataFrame, v: str = "value", low: float = 5.0) -> DataFrame:
    """Zero streaks, low ratio, flat windows, head-to-tail drop, slope and missing share among low days (observed = not missing)."""
    d, n = F.col(DAY), F.col("n_days")
    x = df
    for w in (7, 30):
        fr = by_day().rowsBetween(-(w - 1), 0)
        cnt = F.count(v).over(fr)
        x = x.withColumn(f"_v{w}", F.when((d >= w - 1) & (cnt > 1), F.var_pop(v).over(fr)))
    fill = F.coalesce(v, F.lit(0.0))
    g = x.groupBy(ID).agg((F.sum((F.col(v) < low).cast("int")) / F.greatest(F.count(v), F.lit(1))).alias("low_ratio"),
                          *[(F.sum(F.coalesce((F.col(f"_v{w}") < 0.01).cast("int"), F.lit(0))) / (F.first("n_days") - w + 1)).alias(f"flat_ratio_{w}") for w in (7, 30)],
                          *[F.struct(avg_if(v, d < w).alias("h"), avg_if(v, d >= n - w).alias("t")).alias(f"_h{w}") for w in (30, 90)],
                          F.coalesce(F.regr_slope(v, DAY), F.lit(0.0)).alias("slope"),
                          F.coalesce(div(F.sum(((fill < low) & F.col("is_missing")).cast("int")), F.sum((fill < low).cast("int"))), F.lit(0.0)).alias("missing_in_low"))
    drops = [F.coalesce(F.when(F.abs(f"_h{w}.h") > 1e-6, (F.col(f"_h{w}.h") - F.col(f"_h{w}.t")) / (F.abs(f"_h{w}.h") + 1e-6)), F.lit(0.0)).alias(f"head_tail_drop_{w}") for w in (30, 90)]
    z = run_stats(df, F.col(v) < low, prefix="low_run").drop("low_run_mean")
    return g.select(ID, "low_ratio", "flat_ratio_7", "flat_ratio_30", *drops, "slope", "missing_in_low").join(z, ID)


def risk_features(df: DataFrame, p: DataFrame, v: str = "f", eps: float = 1e-12, segments: int = 34) -> DataFrame:
    """Score, last-90-day, behaviour and week features of the error-risk model (the spectral shares come from spectra)."""
    d, n = F.col(DAY), F.col("n_days")
    w = whole()
    x = df.withColumn("_d", F.col(v) - F.lag(v).over(by_day())).withColumn("_mx", F.max(F.abs(v)).over(w) + eps) \
        .withColumn("_mu", F.avg(v).over(w))
    x = x.withColumn("_sd", F.stddev_pop("_d").over(w) + eps).withColumn("_c", F.col(v) - F.col("_mu")).withColumn("_cl", F.lag(F.col(v) - F.col("_mu")).over(by_day())) \
        .withColumn("_cs", F.sum("_c").over(by_day().rowsBetween(W.unboundedPreceding, 0)))
    r = F.when(d >= n - 90, F.col(v))
    whole_weeks = d < F.floor(n / 7) * 7
    wd, we = whole_weeks & (d % 7 < 5), whole_weeks & (d % 7 >= 5)
    dow = [avg_if(v, whole_weeks & (d % 7 == k)) for k in range(7)]
    g = x.groupBy(ID).agg(
        F.avg(r).alias("mean90"), F.var_pop(r).alias("var90"), F.regr_slope(r, F.col(DAY)).alias("trend90"), nz(F.kurtosis(r)).alias("kurt90"), nz(F.skewness(r)).alias("skew90"),
        ((F.stddev_pop(r) + eps) / (F.abs(F.avg(r)) + eps)).alias("cv90"), (avg_if(v, d >= n - 7) / (avg_if(v, d >= n - 28) + eps)).alias("week_month_ratio"),
        F.avg((F.abs("_d") < 0.01 * F.col("_mx")).cast("double")).alias("flat"), F.avg((F.abs("_d") > 3 * F.col("_sd")).cast("double")).alias("jump"),
        (F.sum(F.col("_c") * F.col("_cl")) / (F.sum(F.col("_c") * F.col("_c")) + eps)).alias("autocorr"),
        (F.max(F.abs("_cs")) / ((F.stddev_pop(v) + eps) * F.sqrt(F.first("n_days").cast("double")))).alias("cusum"),
        (avg_if(v, wd) / (avg_if(v, we) + eps)).alias("weekday_weekend"), (F.greatest(*dow) / (avg_if(v, whole_weeks) + eps)).alias("dow_max"),
        (avg_if(v, we) / (avg_if(v, whole_weeks) + eps)).alias("weekend_share"))
    q, rem = F.floor(n / segments), n % segments
    seg = F.when(d < rem * (q + 1), F.floor(d / (q + 1))).otherwise(rem + F.floor((d - rem * (q + 1)) / q))
    s = df.groupBy(ID, seg.alias("_seg")).agg(F.avg(v).alias("_a"), (F.stddev_pop(v) / (F.abs(F.avg(v)) + eps)).alias("_cv"))
    s = s.groupBy(ID).agg(F.avg("_cv").alias("month_cv"), F.regr_slope("_a", "_seg").alias("month_trend"))
    z = run_stats(df, F.col(v) <= eps, prefix="zero").select(ID, F.col("zero_longest").alias("zero_run"))
    pp = p.select(ID, F.greatest(F.col("p"), 1 - F.col("p")).alias("max_prob"), F.abs(F.col("p") - 0.5).alias("margin"),
                  (-(F.col("p") * F.log(F.col("p") + eps) + (1 - F.col("p")) * F.log(1 - F.col("p") + eps))).alias("entropy"))
    return g.join(s, ID).join(z, ID).join(pp, ID)


def channel_features(df: DataFrame, channels: list[str]) -> DataFrame:
    """Twelve statistics per channel (long form). Channels stay columns until each series is one row, so a day is
    one row in every sort, not one for each channel."""
    x = df.select(ID, DAY, "n_days", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(channels)])
    each = range(len(channels))
    x = x.select("*", *[(F.col(f"_v{i}") - F.avg(f"_v{i}").over(whole())).alias(f"_m{i}") for i in each])
    x = x.select("*", *[F.lag(f"_m{i}", k).over(by_day()).alias(f"_l{i}_{k}") for i in each for k in (1, 7, 30)])
    h = F.floor(F.col("n_days") / 2)
    aggs = []
    for i in each:
        v, m = f"_v{i}", F.col(f"_m{i}")
        q = pct(v, .25, .5, .75)  # one pass for the three
        stats = {"mean": F.avg(v), "std": F.stddev_pop(v), "median": q[1], "min": F.min(v), "max": F.max(v), "q25": q[0], "q75": q[2],
                 "half_change": avg_if(v, F.col(DAY) >= h) - avg_if(v, F.col(DAY) < h), "zero_ratio": share(F.col(v) == 0)}
        stats |= {f"acov_{k}": F.avg(m * F.col(f"_l{i}_{k}")) / (F.avg(m * m) + 1e-12) for k in (1, 7, 30)}
        aggs.append(F.struct(F.lit(channels[i]).alias("channel"), *[e.alias(n) for n, e in stats.items()]).alias(f"_s{i}"))
    g = x.groupBy(ID).agg(*aggs)
    return g.select(ID, F.explode(F.array(*[f"_s{i}" for i in each])).alias("s")).select(ID, "s.*")


def channel_pairs(df: DataFrame, channels: list[str]) -> DataFrame:
    """Mean product and mean squared difference of every channel pair, all in one aggregation."""
    aggs = []
    for i, a in enumerate(channels):
        for b in channels[i + 1:]:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            aggs += [F.avg(x * y).alias(f"{a}_{b}_prod"), F.avg((x - y) * (x - y)).alias(f"{a}_{b}_sqdiff")]
    return df.groupBy(ID).agg(*aggs)


def ljung_box(df: DataFrame, v: str = "f", lags: int = 10) -> DataFrame:
    """Q = n * sum of squared lag correlations; the chi-square tail for even degrees of freedom is a finite sum."""
    w = by_day()
    x = df.select(ID, v, *[F.lag(v, k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    q = sum((F.pow(safe_corr(v, f"_l{k}"), F.lit(2.0)) for k in range(1, lags + 1)), F.lit(0.0))
    g = x.groupBy(ID).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop(v).alias("_s"), q.alias("_q"))
    g = g.withColumn("q", F.col("_n") * F.col("_q"))
    h, term, tot = F.col("q") / 2, F.lit(1.0), F.lit(1.0)
    for j in range(1, lags // 2):
        term = term * h / j
        tot = tot + term
    ok = (F.col("_n") > 20) & (F.col("_s") > 1e-6)
    return g.select(ID, "q", F.when(ok, F.least(F.exp(-h) * tot, F.lit(1.0))).otherwise(1.0).alias("p_value"))


def observed_means(panel: DataFrame) -> DataFrame:
    return panel.groupBy(ID).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("m"))


def behaviour_profile(panel: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Near-zero share, rank among series, stable-low share, anomaly days and runs, bimodality, half-to-half deviation.

    means (series_id, m): observed means if already at hand, so that ranking them does not read the panel again."""
    x = C.fill_with_series_median(panel).withColumn("f", F.col("filled"))
    if means is None:
        means = observed_means(panel)
    ranks = means.join(mean_ranks(means, "m"), F.col("m") == F.col("key")).select(ID, (F.col("rank") / F.col("n")).alias("global_rank_pct"))
    pos = F.when(F.col("f") > 0, F.col("f"))
    w = whole()
    x = x.withColumn("_q", pct("f", .10, .15).over(w)).withColumn("_pq", F.percentile(pos, [.25, .5, .75]).over(w)) \
        .withColumn("_dev", F.col("f") - C.moving_average("f", 7))
    anom = F.col("f") < F.greatest(F.col("_q")[0] * 0.5, F.lit(0.01))
    d, n = F.col(DAY), F.col("n_days")
    pq = F.col("_pq")
    half = F.floor(n / 2)
    g = x.groupBy(ID).agg(share(F.col("f") < 0.01).alias("near_zero_ratio"), share(F.col("f") < F.greatest(F.col("_q")[1], F.lit(0.01))).alias("stable_low_ratio"),
                          F.coalesce(F.stddev_pop(pos) / (F.avg(pos) + 1e-6), F.lit(0.0)).alias("cv_daily"), share(anom).alias("anomaly_ratio"),
                          F.count(pos).alias("_np"), F.first(pq[2] > pq[0]).alias("_sp"), F.sum(((pos >= pq[0]) & (pos <= pq[1])).cast("int")).alias("_lo"),
                          F.sum(((pos >= pq[1]) & (pos <= pq[2])).cast("int")).alias("_hi"),
                          (F.stddev_pop(F.when(d < half, F.col("_dev"))) / (F.stddev_pop(F.when(d >= half, F.col("_dev"))) + 1e-6)).alias("half_deviation_ratio"))
    bi = F.when((F.col("_np") > 20) & F.col("_sp"), 1 - F.abs(F.col("_lo") - F.col("_hi")) / F.greatest(F.col("_lo") + F.col("_hi"), F.lit(1))).otherwise(0.0)
    g = g.select(ID, "near_zero_ratio", "stable_low_ratio", "cv_daily", "anomaly_ratio", bi.alias("bimodality"), "half_deviation_ratio")
    rl = run_stats(x, anom, prefix="anom").select(ID, F.col("anom_mean").alias("mean_run_length"))
    return g.join(ranks, ID).join(rl, ID)


def cohort_features(df: DataFrame, cohorts: DataFrame, cutoff: int, v: str = "f") -> DataFrame:
    """Level against the cohort (low share, daily-median ratio), recent level, rank drop, within-month change."""
    x = df.join(cohorts, ID)
    counts = x.groupBy("cohort", DAY, v).agg(F.count(F.lit(1)).alias("_c"))
    p15 = counted_quantiles(counts, v, {"p15": .15}, ["cohort"], "_c")
    med = grouped_quantiles(counts, v, {"cmed": .5}, ["cohort", DAY], "_c")  # cohorts x days rows
    x = x.join(F.broadcast(p15), "cohort").join(F.broadcast(med), ["cohort", DAY])
    d, n = F.col(DAY), F.col("n_days")
    x = x.withColumn("_ratio", F.col(v) / (F.col("cmed") + 1e-6))
    # days of equal value are one row from here on: all that follows is a sum over them, and they share a rank
    parts = {"30": d >= n - 30, "90": d >= n - 90, "hist": d < cutoff}
    x = x.groupBy(ID, v).agg(F.count(F.lit(1)).alias("_c"), F.first("n_days").alias("n_days"), F.first("p15").alias("p15"), F.sum("_ratio").alias("_ratio"),
                             F.count("_ratio").alias("_ratios"), F.count_if(F.col("_ratio") < 0.5).alias("_low"), *[F.count_if(c).alias(f"_c{k}") for k, c in parts.items()])
    before = F.coalesce(F.sum("_c").over(W.partitionBy(ID).orderBy(v).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("_rank", (before + (F.col("_c") + 1) / 2.0) / n)

    def mean(of: str, k: str) -> Column:
        return div(F.sum(F.col(of) * F.when(F.col(f"_c{k}") > 0, F.col(f"_c{k}"))), F.sum(F.when(F.col(of).isNotNull(), F.col(f"_c{k}"))))

    every, hist = F.sum("_c"), mean(v, "hist")
    g = x.groupBy(ID).agg((F.sum(F.when(F.col(v) < F.greatest(F.col("p15"), F.lit(0.01)), F.col("_c")).otherwise(0)) / every).alias("low_ratio"),
                          (mean(v, "30") / (hist + 1e-6)).alias("recent30"), (mean(v, "90") / (hist + 1e-6)).alias("recent90"), div(F.sum("_ratio"), F.sum("_ratios")).alias("peer_dev"),
                          (F.sum("_low") / every).alias("peer_low"), (mean("_rank", "90") - mean("_rank", "hist")).alias("rank_drop"))
    wm = W.partitionBy(ID, F.month("dt"))
    m = df.withColumn("_k", F.row_number().over(wm.orderBy(DAY)) - 1).withColumn("_c", F.count(F.lit(1)).over(wm))
    m = m.withColumn("_h", F.floor(F.col("_c") / 2))
    y1, y2 = F.coalesce(avg_if(v, F.col("_k") < F.col("_h")), F.lit(0.0)), F.coalesce(avg_if(v, F.col("_k") >= F.col("_h")), F.lit(0.0))
    s = m.groupBy(ID, F.month("dt")).agg((F.abs(y1 - y2) / F.greatest(y1, y2, F.lit(0.01))).alias("_y")).groupBy(ID).agg(F.avg("_y").alias("seasonal_change"))
    return g.join(s, ID)


def slope_break(df: DataFrame, shifts: DataFrame, v: str = "f") -> DataFrame:
    """Deviation ratio and slope difference after / before a level shift."""
    x = df.join(shifts.select(ID, "has_cp", "cp"), ID)
    pre, post = F.col(DAY) < F.col("cp"), F.col(DAY) >= F.col("cp")
    g = x.groupBy(ID).agg(F.first("has_cp").alias("has_cp"), (F.stddev_pop(F.when(post, F.col(v))) / (F.stddev_pop(F.when(pre, F.col(v))) + 1e-6)).alias("_v"),
                          (F.regr_slope(F.when(post, F.col(v)), F.col(DAY)) - F.regr_slope(F.when(pre, F.col(v)), F.col(DAY))).alias("_s"))
    hit = F.col("has_cp") == 1
    return g.select(ID, "has_cp", F.when(hit, F.col("_v")).otherwise(1.0).alias("var_ratio"), F.when(hit, F.col("_s")).otherwise(0.0).alias("slope_break"))


def extreme_features(obs: DataFrame, v: str = "value") -> DataFrame:
    """Days above own P95 / global P99 / P99.9 / 10 medians, share and CV of extremes, range, P99, gap entropy and clustering."""
    w = whole()
    gq = global_quantiles(obs, v, {"p99": .99, "p999": .999})
    x = obs.withColumn("_g", gq).withColumn("_q", pct(v, .5, .9, .95, .99).over(w))
    q = F.col("_q")
    ext = F.when(F.col(v) > q[1], F.col(v))
    g = x.groupBy(ID).agg(F.sum((F.col(v) > q[2]).cast("int")).alias("n_above_own_p95"), F.sum((F.col(v) > F.col("_g.p99")).cast("int")).alias("n_above_global_p99"),
                          F.sum((F.col(v) > F.col("_g.p999")).cast("int")).alias("n_above_global_p999"), (F.max(v) / (F.first(q[0]) + 1e-6)).alias("max_median_ratio"),
                          (F.coalesce(F.sum(ext), F.lit(0.0)) / (F.sum(v) + 1e-6)).alias("extreme_sum_ratio"),
                          F.when(F.count(ext) > 3, F.stddev_pop(ext) / (F.avg(ext) + 1e-6)).otherwise(0.0).alias("extreme_cv"),
                          (1 - F.min(v) / (F.max(v) + 1e-6)).alias("max_to_min_range"), F.sum((F.col(v) > 10 * q[0]).cast("int")).alias("n_above_10x_median"), F.first(q[3]).alias("p99_value"))
    gaps = event_gaps(x, F.col(v) > q[2], "pos")
    many = gaps.withColumn("_n", F.count(F.lit(1)).over(whole()))
    he = histogram_entropy(many.where("_n > 1").withColumn("_b", F.least(F.lit(10), F.col("_n"))), "gap", F.col("_b"), [ID]).select(ID, F.col("entropy").alias("_e"))
    cl = clustering_index(gaps)
    return g.join(he, ID, "left").join(cl, ID, "left").select(*g.columns, F.coalesce("_e", F.lit(0.0)).alias("gap_entropy"), F.coalesce("clustering", F.lit(0.0)).alias("clustering"))


def event_gaps(df: DataFrame, pred: Column, order: str = DAY) -> DataFrame:
    """Distances between consecutive rows where `pred` holds."""
    e = df.where(pred).withColumn("gap", F.col(order) - F.lag(order).over(by_day(order)))
    return e.where("gap is not null").select(ID, order, "gap")


def clustering_index(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy(ID).agg((F.var_pop("gap") / F.pow(F.avg("gap") + 1e-6, F.lit(2.0))).alias("clustering"))


def load_features(df: DataFrame, v: str = "value") -> DataFrame:
    """Load factor mean/P95 (observed), post/pre ratio at three quarters, largest 30-day drop and spike, largest cumulative deviation."""
    lf = df.where(F.col(v).isNotNull()).groupBy(ID).agg(F.count(v).alias("_n"), (F.avg(v) / (pct(v, .95)[0] + 1e-6)).alias("_lf")) \
        .select(ID, F.when(F.col("_n") >= 30, F.col("_lf")).otherwise(1.0).alias("load_factor"))
    x = df.withColumn("f", F.coalesce(v, F.lit(0.0)))
    sp = F.greatest(F.lit(1), F.floor(F.col("n_days") * 3 / 4))
    pre, post = avg_if("f", F.col(DAY) < sp), avg_if("f", F.col(DAY) >= sp)
    r = moving_average_mirrored(x, "f", 30, "_r")
    r = r.withColumn("_d", F.coalesce(F.lead("_r").over(by_day()) - F.col("_r"), F.lit(0.0)))
    g = with_cumulative_deviation(r, "f", "_c").groupBy(ID).agg((post / (pre + 1e-6)).alias("post_pre_ratio"), F.min("_d").alias("max_drop_30d"), F.max("_d").alias("max_spike_30d"), F.max(F.abs("_c")).alias("cusum_abs_max"))
    return lf.join(g, ID)


def regime_stats(df: DataFrame, v: str = "value") -> DataFrame:
    """Means, deviations, missing and zero shares before / after three quarters; cumulative range, low run, drawdown."""
    sp = F.greatest(F.lit(1), F.floor(F.col("n_days") * 3 / 4))
    side = {"pre": F.col(DAY) < sp, "post": F.col(DAY) >= sp}
    aggs = []
    for k, c in side.items():
        aggs += [avg_if(v, c).alias(f"{k}_mean"), F.stddev_pop(F.when(c, F.col(v))).alias(f"{k}_std"), avg_if(F.col("is_missing").cast("double"), c).alias(f"{k}_miss"),
                 (F.sum(F.coalesce((c & (F.col(v) < 10)).cast("int"), F.lit(0))) / F.greatest(F.count(F.when(c, F.col(v))), F.lit(1))).alias(f"{k}_low")]
    g = df.groupBy(ID).agg(*aggs)

    def rel(k):
        return F.when(F.col(f"pre_{k}") > 0, F.col(f"post_{k}") / (F.col(f"pre_{k}") + 1e-6)).otherwise(F.when(F.col(f"post_{k}") > 0, 2.0).otherwise(1.0))

    g = g.withColumn("ratio_mean", F.col("post_mean") / (F.col("pre_mean") + 1e-6)).withColumn("ratio_miss", rel("miss")).withColumn("ratio_low", rel("low"))
    med = df.withColumn("_med", F.median(v).over(whole()))
    low = run_stats(med, F.col(v) < F.col("_med"), prefix="low").select(ID, F.when(F.col("low_longest") >= 5, F.col("low_longest")).otherwise(0).alias("low_run"))
    return g.join(low, ID)


def drawdown(df: DataFrame, v: str) -> DataFrame:
    """Largest fall of the running total of `v` below its running maximum, absolute and relative to the final maximum."""
    up = by_day().rowsBetween(W.unboundedPreceding, 0)
    x = df.withColumn("_c", F.sum(v).over(up))
    x = x.withColumn("_x", F.max("_c").over(up)).withColumn("_dd", F.col("_x") - F.col("_c"))
    g = x.groupBy(ID).agg(F.max("_dd").alias("max_drawdown"), F.max("_x").alias("_top"), F.max_by(DAY, F.struct(F.round("_dd", 6), -F.col(DAY))).alias("drawdown_day"))
    return g.select(ID, "max_drawdown", (F.col("max_drawdown") / (F.col("_top") + 1e-6)).alias("drawdown_share"), "drawdown_day")


def log_scale_stats(df: DataFrame, v: str = "f") -> DataFrame:
    x = F.log1p(v)
    return df.groupBy(ID).agg(F.avg(x).alias("log_mean"), F.stddev_pop(x).alias("log_std"), F.max(x).alias("log_max"), F.median(x).alias("log_median"),
                              share(F.col(v) == 0).alias("zero_ratio"), share(F.col(v) < 1).alias("below_1_ratio"))


def compact_behaviour(panel: DataFrame, cohorts: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """The compact behaviour block: level, rank, cumulative score, half ratio, anomalies, correlations, residual, peers, months."""
    w = whole()
    d, n = F.col(DAY), F.col("n_days")
    x = C.fill_with_series_median(panel).withColumn("f", F.col("filled"))
    x = x.withColumn("_c", F.col("f") - F.avg("f").over(w)).withColumn("_c2", F.pow(F.col("f") - F.avg("f").over(w), F.lit(2.0)))
    x = x.withColumn("_cs", F.sum("_c").over(by_day().rowsBetween(W.unboundedPreceding, 0)))
    x = moving_average_mirrored(x, "_c2", 60, "_rv").withColumn("_rs", F.sqrt(F.col("_rv") + 1e-6)).withColumn("_p10", pct("f", .1).over(w)[0]) \
        .withColumn("_res", F.col("f") - C.moving_average("f", 7)).withColumn("_l1", F.lag("f", 1).over(by_day())).withColumn("_l7", F.lag("f", 7).over(by_day()))
    half = F.floor(n / 2)
    x = x.withColumn("_sm", F.avg(F.when(d >= half, F.col("value"))).over(w))
    anom = (F.col("f") < F.greatest(F.col("_p10") * 0.5, F.lit(0.01))).cast("double")
    mean, sd = F.coalesce(F.avg("value"), F.lit(0.0)), F.coalesce(F.stddev_pop("value"), F.lit(0.0))
    first = avg_if("value", d < half)
    live = F.stddev_pop("f") > 1e-6
    g = x.groupBy(ID).agg(mean.alias("mean"), sd.alias("std"), (sd / (mean + 1e-6)).alias("cv"), share(F.col("value") < 10).alias("low_rate"), share(F.col("is_missing")).alias("miss_rate"),
                          (avg_if("value", d >= half) / (first + 1e-6)).alias("change_ratio"),
                          F.coalesce(F.avg(F.when(d >= half, F.coalesce((F.col("value") < F.col("_sm") * 1.5).cast("double"), F.lit(0.0)))), F.lit(0.0)).alias("change_persistence"),
                          (F.max(F.abs("_cs")) / (F.avg("_rs") + 1e-6)).alias("cusum_score"), F.avg(anom).alias("anomaly_ratio"), F.stddev_pop(anom).alias("anom_std"),
                          F.when(live, safe_corr("f", "_l1")).otherwise(0.0).alias("acf1"), F.when(live, safe_corr("f", "_l7")).otherwise(0.0).alias("acf7"),
                          (F.stddev_pop("_res") / (F.stddev_pop("f") + 1e-6)).alias("res_std"), nz(F.skewness("_res")).alias("res_skew"), share(F.col("f") < 0.01).alias("near_zero"))
    m = x.groupBy(ID, F.month("dt").alias("_m")).agg(F.count(F.lit(1)).alias("_n"), (F.stddev_pop("f") / (F.avg("f") + 1e-6)).alias("_cv")).where("_n > 5") \
        .groupBy(ID).agg(F.avg("_cv").alias("monthly_cv"), (F.max("_cv") - F.min("_cv")).alias("monthly_range"))
    if means is None:
        means = observed_means(panel)
    ranks = means.join(mean_ranks(means, "m"), F.col("m") == F.col("key")).select(ID, (F.col("rank") / F.col("n")).alias("global_rank"))
    co = means.join(cohorts, ID)
    peers = exact_quantiles(co, "m", {"pm": .5}, by=["cohort"])
    dev = co.join(F.broadcast(peers), "cohort").select(ID, (F.col("m") / (F.col("pm") + 1e-6)).alias("peer_dev"))
    return g.join(m, ID).join(ranks, ID).join(dev, ID)
