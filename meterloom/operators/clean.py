"""Imputation, clipping, scaling, resampling and decomposition of panels."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import clip, col
from ..session import cut_lineage
from .panel import DAY, ID, _emit_days, _indexed, by_day, moving_average, whole
from .ranking import exact_quantiles, global_quantiles, weighted_quantiles


def sanitize(x: str | Column) -> Column:
    """NULL, NaN and +-Infinity become 0."""
    c = col(x).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def fill_with_series_median(panel: DataFrame) -> DataFrame:
    return panel.withColumn("filled", F.coalesce("value", F.median("value").over(whole()), F.lit(0.0)))


def _neighbours(pos: str, value: str, part=ID):
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    return _latest(seen, F.col(pos).asc(), part), _latest(seen, F.col(pos).desc(), part)


def _latest(seen: Column, order: Column, part=ID) -> Column:
    """Last non-NULL so far. The look-ahead uses the reversed order: a frame from the current row to the end
    would be evaluated anew for every row."""
    return F.last(seen, True).over(W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def _lerp(pos: str) -> Column:
    run = F.col("_n.p") - F.col("_b.p")
    return F.when(F.col("_b").isNull(), F.col("_n.v")).when(F.col("_n").isNull(), F.col("_b.v")) \
        .when(run == 0, F.col("_b.v")) \
        .otherwise(F.col("_b.v") + (F.col("_n.v") - F.col("_b.v")) * (F.col(pos) - F.col("_b.p")) / run)


def interpolate(df: DataFrame, pos: str = DAY, value: str = "value", out: str = "filled",
                max_gap: int | None = None, hold_edges: bool = True) -> DataFrame:
    """Linear interpolation along `pos`; edges hold the nearest value; longer gaps than max_gap stay NULL.

    A panel densified with `neighbours` brings them along; otherwise two windows look them up."""
    res = _lerp(pos)
    if not hold_edges:
        res = F.when(F.col("_b").isNotNull() & F.col("_n").isNotNull(), res)
    if max_gap is not None:
        res = F.when(F.col("_n.p") - F.col("_b.p") - 1 <= max_gap, res)
    if "_b" not in df.columns:
        b, n = _neighbours(pos, value)
        df = df.withColumn("_b", b).withColumn("_n", n)
    return df.withColumn(out, F.coalesce(value, res)).drop("_b", "_n")


def tier_bounds(means: DataFrame, value: str = "m") -> Column:
    """20/40/60/80 % points of the positive series means as a scalar struct."""
    return global_quantiles(means.where(F.col(value) > 0), value, {"t1": .2, "t2": .4, "t3": .6, "t4": .8})


def tier_of(m: Column, b: str) -> Column:
    return F.when(m <= 0, 0).when(m <= F.col(f"{b}.t1"), 1).when(m <= F.col(f"{b}.t2"), 2) \
        .when(m <= F.col(f"{b}.t3"), 3).when(m <= F.col(f"{b}.t4"), 4).otherwise(5)


def impute_layers(panel: DataFrame, max_gap: int = 7) -> DataFrame:
    """Short gaps by interpolation, then the meter's own month+weekday mean, then the mean of its tier that day."""
    own = W.partitionBy(ID, F.month("dt"), F.weekday("dt"))
    means = panel.groupBy(ID).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("m"))
    tiers = means.withColumn("_t", tier_bounds(means)).select(ID, tier_of(F.col("m"), "_t").alias("tier"))
    # tiers x days rows: six tiers by the calendar
    peers = (panel.where("not is_missing").join(tiers, ID).groupBy("tier", DAY)
             .agg(F.avg("value").alias("peer")))
    base = interpolate(panel, out="l1", max_gap=max_gap, hold_edges=False) \
        .withColumn("l2", F.avg("value").over(own)).join(tiers, ID)
    return (base.join(F.broadcast(peers), ["tier", DAY], "left")
            .withColumn("filled", F.coalesce("l1", "l2", "peer", F.lit(0.0)))
            .withColumn("layer", F.when(F.col("value").isNotNull(), 0).when(F.col("l1").isNotNull(), 1)
                        .when(F.col("l2").isNotNull(), 2).when(F.col("peer").isNotNull(), 3).otherwise(4)))


def day_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of every calendar day over all series (days are bounded by the calendar)."""
    return exact_quantiles(df, value, probs, by=[DAY])


def day_table(obs: DataFrame, threshold: float) -> DataFrame:
    """One row per calendar day: dense flag, position among the dense days, median of the observed values."""
    seen = obs.where("value is not null")
    series = obs.agg(F.count_distinct(ID).alias("n")).scalar()
    have = seen.groupBy(F.col(DAY).alias("_c")).agg(F.count(F.lit(1)).alias("c"))
    days = obs.agg(F.max(DAY).alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias(DAY))
    rate = days.join(have, F.col(DAY) == F.col("_c"), "left").select(DAY, ((series - F.coalesce("c", F.lit(0))) / series).alias("miss_rate"))
    # running count over the calendar: a few thousand rows
    pos = rate.withColumn("dense", F.col("miss_rate") <= threshold).withColumn("dpos", F.sum(F.col("dense").cast("int")).over(W.orderBy(DAY)) - 1)
    return pos.join(day_quantiles(seen, "value", {"day_median": 0.5}), DAY, "left").select(DAY, "dense", "dpos", "day_median")


def impute_by_sparsity(readings: DataFrame, threshold: float = 0.3, date_col: str = "dt") -> DataFrame:
    """Days missing for more than `threshold` of the series take the day's median; the other days are
    interpolated along their own sequence (position among dense days); what is left takes the day's median.

    Works from the observed rows: day statistics are small aggregates, the neighbours among dense days are found in the
    one sort that also densifies, and the dense rows need no window.
    """
    r = _indexed(readings, date_col)
    days = day_table(r.withColumnRenamed("_d", DAY), threshold)
    sparse = r.join(F.broadcast(days.select(F.col(DAY).alias("_d"), "dense", "dpos")), "_d").withColumnRenamed("value", "_v")
    p = _emit_days(sparse, True, seen=F.col("dense"), pos="dpos").join(F.broadcast(days), DAY)
    val = F.coalesce("value", F.when(F.col("dense"), _lerp("dpos")), "day_median", F.lit(0.0))
    return p.withColumn("filled", val).drop("_b", "_n", "dpos")


def clip_to_day_mad(df: DataFrame, value: str, width: float = 5.0, out: str = "clipped") -> DataFrame:
    """Clip to day median +- width * MAD; days with MAD 0 are left alone."""
    med = cut_lineage(day_quantiles(df, value, {"med": 0.5}))  # a row for each day, read by both passes that follow
    dev = df.join(F.broadcast(med), DAY)
    mad = day_quantiles(dev.withColumn("_ad", F.abs(F.col(value) - F.col("med"))), "_ad", {"mad": 0.5})
    x = dev.join(F.broadcast(mad), DAY)
    lo, hi = F.col("med") - width * F.col("mad"), F.col("med") + width * F.col("mad")
    return x.withColumn(out, F.when(F.col("mad") > 0, F.least(F.greatest(F.col(value), lo), hi))
                        .otherwise(F.col(value)))


def winsorize_log(df: DataFrame, value: str = "f", lo: float = 0.01, hi: float = 0.99,
                  fit: DataFrame | None = None) -> DataFrame:
    """Clip to global percentiles (fitted on `fit`, default the data itself), then log1p of the positive part."""
    b = global_quantiles(fit if fit is not None else df, value, {"lo": lo, "hi": hi})
    return (df.withColumn("_q", b)
            .withColumn("winsorized", F.least(F.greatest(F.col(value), F.col("_q.lo")), F.col("_q.hi")))
            .withColumn("transformed", F.log1p(F.greatest(F.col("winsorized"), F.lit(0.0)))).drop("_q"))


def winsorize_by_fold(df: DataFrame, folds: DataFrame, n_folds: int, value: str = "f") -> DataFrame:
    """Every fold is transformed with bounds fitted on the other folds only (no leakage)."""
    rows = df.join(folds, ID)
    others = {k: (F.col("fold") != k).cast("long") for k in range(n_folds)}
    stats = weighted_quantiles(rows, value, {"lo": .01, "hi": .99, "p95": .95, "p99": .99, "p999": .999}, others, "fold")
    x = F.least(F.greatest(F.col(value), F.col("lo")), F.col("hi"))
    return rows.join(F.broadcast(stats), "fold").withColumn("transformed", F.log1p(F.greatest(x, F.lit(0.0))))


def zscore_channels(df: DataFrame, value: str = "f") -> DataFrame:
    """Per-series z of the value and of its first difference (the first difference is repeated at day 0)."""
    w = whole()
    d = F.col(value) - F.lag(value).over(by_day())
    df = df.withColumn("_d0", d).withColumn("diff", F.coalesce("_d0", F.lead("_d0").over(by_day()), F.lit(0.0)))

    def z(c):
        return (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-6)

    return df.withColumn("z_value", z(value)).withColumn("z_diff", z("diff")).drop("_d0")


def standardize_by_day(df: DataFrame, value: str = "f") -> DataFrame:
    """log1p, standardized per day over all series, clipped to +-5, plus missing and zero channels."""
    x = F.log1p(F.greatest(F.col(value), F.lit(0.0)))
    stats = df.groupBy(DAY).agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"))
    z = (x - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return (df.join(F.broadcast(stats), DAY).withColumn("scaled", clip(z, -5, 5))
            .withColumn("ch_missing", F.col("is_missing").cast("int"))
            .withColumn("ch_zero", (F.col(value) == 0).cast("int")))


def rolling_std(value: str, width: int = 7) -> Column:
    return F.stddev_pop(value).over(by_day().rowsBetween(-(width - 1), 0))


def level_code(v: Column, cuts: tuple[float, ...]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + (v >= c).cast("int")
    return out


def window_entropy(df: DataFrame, value: str = "f", width: int = 30, stride: int = 7,
                   cuts: tuple[float, ...] = (1, 10, 25, 50, 100)) -> DataFrame:
    """Entropy of level codes in windows [stride*w, stride*w + width), carried forward to days."""
    d = F.col(DAY)
    n_win = F.floor((F.col("n_days") - width) / stride)
    first = F.greatest(F.ceil((d - (width - 1)) / stride), F.lit(0))
    last = F.least(F.floor(d / stride), n_win)
    hits = df.where(first <= last).select(ID, F.explode(F.sequence(first, last)).alias("win"),
                                          level_code(F.col(value), cuts).alias("lev"))
    cells = hits.groupBy(ID, "win", "lev").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / float(width)
    ent = cells.groupBy(ID, "win").agg(F.sum(-p * F.log(p)).alias("entropy"))
    days = df.withColumn("win", F.greatest(F.least(F.floor((d - (width - 1)) / stride), n_win), F.lit(0)))
    return days.join(ent, [ID, "win"], "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))


def seasonal_residual(df: DataFrame, value: str = "f", period: int = 7) -> DataFrame:
    """trend = centred moving average, seasonal = mean detrended value per position in the period, residual."""
    df = df.withColumn("trend", moving_average(value, period)).withColumn("_ph", F.col(DAY) % period)
    det = F.col(value) - F.col("trend")
    df = df.withColumn("_det", det).withColumn("seasonal", F.avg("_det").over(W.partitionBy(ID, "_ph")))
    return df.withColumn("residual", F.col("_det") - F.col("seasonal")).drop("_det", "_ph")


def two_scale_residual(df: DataFrame, value: str = "f", short: int = 7, long: int = 90) -> DataFrame:
    df = df.withColumn("_det", F.col(value) - moving_average(value, short))
    return df.withColumn("residual2", F.col("_det") - moving_average("_det", long)).drop("_det")


def segment_of(segments: int, d: Column, n: Column) -> Column:
    """Index of the segment [round(i n / S), round((i+1) n / S)) holding day d; rounding is half-to-even."""

    def start(i):
        return F.bround(i * n / F.lit(float(segments)), 0)

    guess = F.floor(d * segments / n).cast("int")
    return F.when(start(guess + 1) <= d, guess + 1).when(start(guess) > d, guess - 1).otherwise(guess)


def paa(df: DataFrame, segments: int, value: str = "value") -> DataFrame:
    """Mean per segment ignoring missing days (0 where a segment has none)."""
    return (df.withColumn("seg", segment_of(segments, F.col(DAY), F.col("n_days")))
            .groupBy(ID, "seg").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("paa")))


def paa_channels(df: DataFrame, resolutions: tuple[int, ...] = (25, 50, 100), value: str = "value") -> DataFrame:
    """Several resolutions in one pass, z-scored per series, clipped to +-5 and padded with 0 to equal length."""
    long = df.select(ID, value, F.explode(F.array(*[
        F.struct(F.lit(r).alias("res"), segment_of(r, F.col(DAY), F.col("n_days")).alias("seg"))
        for r in resolutions])).alias("s")).select(ID, value, "s.*")
    seg = long.groupBy(ID, "res", "seg").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("v"))
    w = W.partitionBy(ID, "res")
    z = clip((F.col("v") - F.avg("v").over(w)) / (F.stddev_pop("v").over(w) + 1e-6), -5, 5)
    top = max(resolutions)
    arr = seg.withColumn("z", z).groupBy(ID, "res").agg(
        F.array_sort(F.collect_list(F.struct("seg", "z"))).alias("a"))
    vals = F.transform("a", lambda e: e["z"])
    padded = F.concat(vals, F.array_repeat(F.lit(0.0), top - F.col("res")))
    return arr.select(ID, "res", padded.alias("channel"))


def gap_channels(df: DataFrame, resolutions: tuple[int, ...] = (25, 50, 100)) -> DataFrame:
    """Missing share and zero-or-missing share per segment and resolution."""
    long = df.select(ID, "is_missing", (F.col("is_missing") | (F.col("value") == 0)).alias("empty"),
                     F.explode(F.array(*[
                         F.struct(F.lit(r).alias("res"), segment_of(r, F.col(DAY), F.col("n_days")).alias("seg"))
                         for r in resolutions])).alias("s")).select(ID, "is_missing", "empty", "s.*")
    return long.groupBy(ID, "res", "seg").agg(F.avg(F.col("is_missing").cast("double")).alias("miss_rate"),
                                              F.avg(F.col("empty").cast("double")).alias("empty_rate"))


def weekly(df: DataFrame, value: str = "f", days: int = 7) -> DataFrame:
    """Mean per whole week (days past the last whole week are dropped) and its z-score per series."""
    w = W.partitionBy(ID)
    wk = F.floor(F.col(DAY) / days)
    out = (df.where(F.col(DAY) < F.floor(F.col("n_days") / days) * days)
           .groupBy(ID, wk.cast("int").alias("week")).agg(F.avg(value).alias("week_mean")))
    return out.withColumn("week_z", (F.col("week_mean") - F.avg("week_mean").over(w))
                          / (F.stddev_pop("week_mean").over(w) + 1e-6))


def adaptive_pool(df: DataFrame, length: int, value: str = "f") -> DataFrame:
    """Adaptive average pooling: cell i covers [floor(i n / L), ceil((i+1) n / L)), neighbours may overlap."""
    d, n = F.col(DAY), F.col("n_days")
    guess = F.floor(d * length / n)
    cells = F.filter(F.array(guess - 1, guess, guess + 1), lambda i: (i >= 0) & (i < length)
                     & (F.floor(i * n / length) <= d) & (F.ceil((i + 1) * n / length) > d))
    return (df.select(ID, value, F.explode(cells).alias("cell"))
            .groupBy(ID, F.col("cell").cast("int").alias("cell")).agg(F.avg(value).alias("pooled")))


def sliding_rows(df: DataFrame, keys: list[str], order: str, width: int, step: int) -> DataFrame:
    """Row-number windows anchored at the first row of each group; groups shorter than `width` are dropped.

    Adds win and pos (offset in the window). Each row is emitted once per window that holds it.
    """
    w = W.partitionBy(*keys)
    df = df.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    first = F.greatest(F.ceil((F.col("_r") - (width - 1)) / step), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col("_r") / step), F.floor((F.col("_n") - width) / step)).cast("int")
    return (df.where((F.col("_n") >= width) & (first <= last))
            .withColumn("win", F.explode(F.sequence(first, last)))
            .withColumn("pos", F.col("_r") - F.col("win") * step).drop("_r", "_n"))


def standardize_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    """Global mean / population deviation per channel (one row of statistics) and an all-ones mask channel."""
    stats = df.agg(F.struct(*[F.avg(c).alias(f"{c}_m") for c in channels],
                            *[F.stddev_pop(c).alias(f"{c}_s") for c in channels]).alias("s")).scalar()
    df = df.withColumn("_s", stats)
    for c in channels:
        sd = F.col(f"_s.{c}_s")
        df = df.withColumn(c, (F.col(c) - F.col(f"_s.{c}_m")) / F.when(sd > 0, sd).otherwise(F.lit(1.0)))
    return df.withColumn("mask", F.lit(1.0)).drop("_s")


def usage_covariates(panel: DataFrame) -> DataFrame:
    return panel.groupBy(ID).agg(F.log1p(F.max("value")).alias("log_max_usage"),
                                 F.avg(F.col("is_missing").cast("double")).alias("missing_rate"))


# Coefficients of the published rational approximation of the normal quantile function.
_NQ_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
         -3.066479806614716e+01, 2.506628277459239e+00)
_NQ_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
         -1.328068155288572e+01)
_NQ_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
         4.374664141464968e+00, 2.938163982698783e+00)
_NQ_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)


def _poly(cs, x: Column, tail: float | None = None) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + c
    return out if tail is None else out * x + tail


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function as a column expression (relative error below 1.2e-9)."""
    q = p - 0.5
    r = q * q
    tail = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    far = _poly(_NQ_C, tail) / _poly(_NQ_D, tail, 1.0)
    return F.when(p < 0.02425, far).when(p > 1 - 0.02425, -far) \
        .otherwise(_poly(_NQ_A, r) * q / _poly(_NQ_B, r, 1.0))


def quantile_normal(features: DataFrame, folds: DataFrame, n_folds: int, points: int = 21) -> DataFrame:
    """features(series_id, feature, value): map each value through the quantiles of the other folds to a normal.

    The quantile table has points x features x folds rows and is joined to the values on (feature, fold).
    """
    rows = features.join(folds, ID)
    others = rows.select("feature", "value", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col("fold"))).alias("fold"))
    probs = {f"q{i}": i / (points - 1) for i in range(points)}
    ref = exact_quantiles(others, "value", probs, by=["feature", "fold"]) \
        .select("feature", "fold", F.array(*probs).alias("ref"))
    lo = F.size(F.filter("ref", lambda r: r < F.col("value")))
    le = F.size(F.filter("ref", lambda r: r <= F.col("value")))

    def edge(k, up):  # position of the value between neighbouring reference points, counted from one side
        i = F.least(F.greatest(k, F.lit(1)), F.lit(points - 1))
        a, b = F.get("ref", i - 1), F.get("ref", i)
        t = F.when(b > a, (F.col("value") - a) / (b - a)).otherwise(F.lit(float(up)))
        return (i - 1 + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))) / float(points - 1)

    u = (edge(lo, 0) + edge(le, 1)) / 2.0  # ties take the middle of their span
    return rows.join(ref, ["feature", "fold"]).select(
        ID, "feature", "fold", "value", normal_quantile(clip(u, 1e-7, 1 - 1e-7)).alias("normal"))
