"""Profiles, regularity, risk and behaviour features (inventory C-23 .. C-41)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import clean as C, profiles as R, series_stats as S
from ..sources import tables as T
from .catalog import query
from .panel_plans import STL, ma_sql
from .series_plans import TIERS, runs_sql, series_means
from .sqlbase import OBSERVED, PANEL, sel


def hist_sql(src: str, v: str, keys: str, bins: str, cte: str) -> str:
    """CTE `cte`(keys, bins, n, entropy): equal-width histogram entropy of v per keys."""
    return f"""{cte}_a AS (SELECT *, {bins} AS bins, min({v}) OVER (PARTITION BY {keys}) AS lo_, max({v}) OVER (PARTITION BY {keys}) AS hi_ FROM {src}),
{cte}_b AS (SELECT {keys}, bins, CASE WHEN hi_ > lo_ THEN least(floor(({v} - lo_) * bins / (hi_ - lo_)::DOUBLE), bins - 1) ELSE 0 END AS cell, count(*) AS c FROM {cte}_a GROUP BY ALL),
{cte}_c AS (SELECT *, c / sum(c) OVER (PARTITION BY {keys}, bins) AS p FROM {cte}_b),
{cte} AS (SELECT {keys}, bins, sum(c) AS n, sum(-p * ln(p)) AS entropy FROM {cte}_c GROUP BY ALL)"""


@query("multiscale_regularity", "C-23", sel(PANEL + """,
x AS (SELECT *, f - lag(f) OVER w AS d, lag(f) OVER w AS l, f > quantile_cont(f, 0.5) OVER (PARTITION BY series_id) AS hi FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY day_idx)),
y AS (SELECT *, sign(d) <> lag(sign(d)) OVER (PARTITION BY series_id ORDER BY day_idx) AS ch, coalesce(hi <> lag(hi) OVER (PARTITION BY series_id ORDER BY day_idx), false) AS flip FROM x),
z AS (SELECT *, sum(flip::INT) OVER (PARTITION BY series_id ORDER BY day_idx) AS run FROM y),
g AS (SELECT series_id, stddev_pop(d) / (stddev_pop(f) + 1e-6) AS diff_level_ratio, count(*) FILTER (ch) / count(*)::DOUBLE AS direction_changes, coalesce(corr(f, l), 0) AS acf1 FROM z GROUP BY 1),
ru AS (SELECT series_id, run, any_value(hi) AS hi, count(*) AS len FROM z GROUP BY ALL),
rn AS (SELECT *, (SELECT least(10, count(DISTINCT len)) FROM ru r2 WHERE r2.series_id = ru.series_id) AS nb FROM ru),
pz AS (SELECT series_id, f, k FROM panel, (VALUES (5), (10), (20)) t(k) WHERE f > 0),
lr AS (SELECT series_id, coalesce(max(len) FILTER (hi), 0) / sum(len)::DOUBLE AS longest_high_run FROM ru GROUP BY 1),
""" + hist_sql("pz", "f", "series_id, k", "k", "he") + ",\n" + hist_sql("rn", "len", "series_id", "nb", "re") + """,
hp AS (SELECT series_id, """ + ", ".join(f"max(entropy / ln({k})) FILTER (k = {k} AND n >= 10) AS entropy_{k}" for k in (5, 10, 20)) + " FROM he GROUP BY 1)",
    "g JOIN hp USING (series_id) JOIN lr USING (series_id) JOIN re USING (series_id)", "series_id",
    ["diff_level_ratio", "direction_changes", "acf1", "entropy_5", "entropy_10", "entropy_20", ("re.entropy", "run_entropy"), "longest_high_run"], 5))
def _(spark, sf):
    return rounded(R.multiscale_regularity(T.filled(spark, sf)), 5)


@query("patch_features", "C-24", sel(PANEL + """,
h AS (SELECT series_id, f, k FROM panel, range(400) t(k) WHERE day_idx >= 15 * k AND day_idx < 15 * k + 30 AND k <= (n_days - 30) // 15),
p AS (SELECT series_id, k, avg(f) AS m, stddev_pop(f) AS s, max(f) AS hi, min(f) AS lo FROM h WHERE f > 0.01 GROUP BY ALL HAVING count(*) >= 3),
q AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series_id) AS np, lag(m) OVER w AS prev FROM p WINDOW w AS (PARTITION BY series_id ORDER BY k)),
r AS (SELECT *, m - prev AS dm, stddev_pop(m - prev) OVER (PARTITION BY series_id) AS sdd FROM q),
gm AS (SELECT series_id, avg(f) + 1e-6 AS gm FROM panel GROUP BY 1),
a AS (SELECT series_id, any_value(np) AS np, avg(m) AS mean_of_means, stddev_pop(m) AS std_of_means, max(m) / (min(m) + 1e-6) AS range_ratio, avg(s) AS mean_of_stds, max(s) AS max_std,
  regr_slope(m, i) AS patch_trend, max(m) - min(m) AS rr, stddev_pop(dm) / (avg(abs(dm)) + 1e-6) AS adjacent_variability, count(*) FILTER (abs(dm) > 2 * sdd) AS jumps, coalesce(corr(m, prev), 0) AS adjacent_corr,
  max(hi) AS hi, min(lo) AS lo, max(hi - lo) AS sp, avg(m) FILTER (i < np // 2) AS e, avg(m) FILTER (i >= np // 2) AS l, stddev_pop(m) FILTER (i < np // 2) AS es, stddev_pop(m) FILTER (i >= np // 2) AS ls FROM r GROUP BY 1)""",
                                     "a JOIN gm USING (series_id)", "series_id",
                                     ["mean_of_means", "std_of_means", "range_ratio", "mean_of_stds", "max_std", "patch_trend", ("rr / gm", "spread"), "adjacent_variability", "jumps", "adjacent_corr",
                                      ("hi / gm", "max_over_mean"), ("lo / gm", "min_over_mean"), ("sp / gm", "max_range"), ("(l - e) / gm", "late_minus_early"), ("ls / (es + 1e-6)", "late_early_std")], 5))
def _(spark, sf):
    return rounded(R.patch_features(T.filled(spark, sf)), 5)


@query("calendar_profile", "C-25", sel(PANEL + """,
x AS (SELECT series_id, 'month' AS kind, (day_idx % 365) * 12 // 365 AS idx, f FROM panel UNION ALL SELECT series_id, 'dow', day_idx % 7, f FROM panel
  UNION ALL SELECT series_id, 'offset' || p, day_idx % p, f FROM panel, (VALUES (7), (30), (90)) t(p)),
m AS (SELECT series_id, avg(f) AS mu FROM panel GROUP BY 1),
a AS (SELECT series_id, kind, CAST(idx AS INTEGER) AS idx, avg(f) AS a FROM x GROUP BY ALL)""", "a JOIN m USING (series_id)", "series_id, kind, idx",
                                       [("a - CASE WHEN kind LIKE 'offset%' THEN mu ELSE 0 END", "value")]))
def _(spark, sf):
    return rounded(R.calendar_profile(T.filled(spark, sf)))


@query("window_trends", "C-25", sel(PANEL + ", g AS (SELECT series_id, " + ", ".join(
    f"avg(f) FILTER (day_idx < {w}) AS a{w}, avg(f) FILTER (day_idx >= n_days - {w}) AS b{w}, (max(f) FILTER (day_idx = n_days - 1) - max(f) FILTER (day_idx = n_days - {w})) / {w - 1} AS step_{w}"
    for w in (7, 14, 30, 60, 90)) + ", " + ", ".join(f"quantile_cont(f, {q / 100}) AS q{q}" for q in (1, 5, 10, 25, 50, 75, 90, 95, 99)) + " FROM panel GROUP BY 1)", "g", "series_id",
    [(f"CASE WHEN abs(a{w}) > 1e-6 THEN (b{w} - a{w}) / (abs(a{w}) + 1e-6) ELSE 0 END", f"change_{w}") for w in (7, 14, 30, 60, 90)] + [f"step_{w}" for w in (7, 14, 30, 60, 90)] + [f"q{q}" for q in (1, 5, 10, 25, 50, 75, 90, 95, 99)]))
def _(spark, sf):
    f = T.filled(spark, sf)
    q = S.percentiles(f, "f", (1, 5, 10, 25, 50, 75, 90, 95, 99)).select("series_id", *[f"q{p}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)])
    return rounded(R.window_trends(f).join(q, "series_id"))


@query("missing_profile", "C-26", sel(PANEL + ",\n" + runs_sql("panel", "is_missing", "gp") + """,
x AS (SELECT *, is_missing::INT AS m, lag(is_missing::INT) OVER (PARTITION BY series_id ORDER BY day_idx) AS pm FROM panel),
gl AS (SELECT series_id, max(length) AS gap_longest FROM gp GROUP BY 1),
g AS (SELECT series_id, avg(m) AS missing, 1 - avg(m) AS observed, """ + ", ".join(
    f"avg(m) FILTER (day_idx >= (n_days * {k}) // 4 AND day_idx < (n_days * {k + 1}) // 4) AS quarter_{k + 1}" for k in range(4)) + ", " + ", ".join(
    f"avg(m) FILTER (day_idx >= (n_days * {k}) // 2 AND day_idx < (n_days * {k + 1}) // 2) AS half_{k + 1}" for k in range(2)) + ", coalesce(sum(m * pm) / nullif(sum(m), 0)::DOUBLE, 0) AS persistence FROM x GROUP BY 1)",
    "g LEFT JOIN gl USING (series_id)", "series_id, coalesce(gap_longest, 0) AS gap_longest", ["missing", "observed", "quarter_1", "quarter_2", "quarter_3", "quarter_4", "half_1", "half_2", "persistence"]))
def _(spark, sf):
    return rounded(R.missing_profile(T.panel(spark, sf)))


_RP = (5, 10, 25, 50, 75, 90, 95)


@query("residual_aggregates", "C-27", sel(STL + """,
g AS (SELECT series_id, avg(residual) AS res_mean, stddev_pop(residual) AS res_std, avg(abs(residual)) AS res_abs_mean, max(abs(residual)) AS res_abs_max,
  avg(residual) FILTER (day_idx < n_days // 2) AS a, avg(residual) FILTER (day_idx >= n_days // 2) AS b, """ + ", ".join(f"quantile_cont(residual, {p / 100}) AS res_p{p}" for p in _RP) + ", "
    + ", ".join(f"avg(abs(residual)) FILTER (day_idx >= n_days - {w}) AS res_abs_last{w}" for w in (30, 60, 90, 180, 365)) + " FROM stl GROUP BY 1)", "g", "series_id",
    ["res_mean", "res_std", "res_abs_mean", "res_abs_max", ("CASE WHEN abs(a) > 1e-6 THEN (b - a) / (abs(a) + 1e-6) ELSE 0 END", "res_half_change")] + [f"res_p{p}" for p in _RP]
    + [f"res_abs_last{w}" for w in (30, 60, 90, 180, 365)], 4))
def _(spark, sf):
    return rounded(R.residual_aggregates(C.seasonal_residual(T.filled(spark, sf))), 4)


@query("observed_trend", "C-28", sel(OBSERVED + ", g AS (SELECT series_id, " + ", ".join(
    f"coalesce(avg(value) FILTER (n >= {2 * w} AND pos < {w}), 0) AS a{w}, coalesce(avg(value) FILTER (n >= {2 * w} AND pos >= n - {w}), 0) AS b{w}" for w in (30, 60, 90, 180)) + " FROM observed GROUP BY 1)", "g", "series_id",
    [(f"(b{w} - a{w}) / (abs(a{w}) + 1e-6)", f"trend_firstlast_{w}") for w in (30, 60, 90, 180)]))
def _(spark, sf):
    return rounded(R.observed_trend(T.observed(spark, sf)))


@query("profile_strength", "C-29", sel(PANEL + """,
dw AS (SELECT series_id, k, coalesce(avg(value) FILTER (day_idx % 7 = k), 0) AS a FROM panel, range(7) t(k) GROUP BY ALL),
mo AS (SELECT series_id, k, coalesce(avg(value) FILTER ((day_idx % 365) // 30 = k), 0) AS a FROM panel, range(12) t(k) GROUP BY ALL),
d AS (SELECT series_id, stddev_pop(a) AS dow_profile_std FROM dw GROUP BY 1), m AS (SELECT series_id, stddev_pop(a) AS month_profile_std FROM mo GROUP BY 1)""",
                                       "d JOIN m USING (series_id)", "series_id", "dow_profile_std, month_profile_std"))
def _(spark, sf):
    return rounded(R.profile_strength(T.panel(spark, sf)))


@query("low_usage_features", "C-30", sel(PANEL + ",\n" + runs_sql("panel", "value < 5", "lo") + """,
v AS (SELECT *, """ + ", ".join(f"avg(value) OVER w{w} AS mu{w}, avg(value * value) OVER w{w} AS ms{w}, count(value) OVER w{w} AS c{w}" for w in (7, 30)) + " FROM panel WINDOW " + ", ".join(
    f"w{w} AS (PARTITION BY series_id ORDER BY day_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (7, 30)) + """),
g AS (SELECT series_id, count(*) FILTER (value < 5) / greatest(count(value), 1)::DOUBLE AS low_ratio, """ + ", ".join(
    f"count(*) FILTER (day_idx >= {w - 1} AND c{w} > 1 AND ms{w} - mu{w} * mu{w} < 0.01) / (any_value(n_days) - {w - 1})::DOUBLE AS flat_ratio_{w}" for w in (7, 30)) + ", " + ", ".join(
    f"avg(value) FILTER (day_idx < {w}) AS h{w}, avg(value) FILTER (day_idx >= n_days - {w}) AS t{w}" for w in (30, 90)) + """, regr_slope(value, day_idx) AS slope,
  coalesce(count(*) FILTER (f < 5 AND is_missing) / nullif(count(*) FILTER (f < 5), 0)::DOUBLE, 0) AS missing_in_low FROM v GROUP BY 1),
lr AS (SELECT series_id, count(*) AS low_run_count, max(length) AS low_run_longest FROM lo GROUP BY 1)""", "g LEFT JOIN lr USING (series_id)",
    "series_id, coalesce(low_run_count, 0) AS low_run_count, coalesce(low_run_longest, 0) AS low_run_longest",
    ["low_ratio", "flat_ratio_7", "flat_ratio_30"] + [(f"coalesce(CASE WHEN abs(h{w}) > 1e-6 THEN (h{w} - t{w}) / (abs(h{w}) + 1e-6) END, 0)", f"head_tail_drop_{w}") for w in (30, 90)] + ["slope", "missing_in_low"]))
def _(spark, sf):
    return rounded(R.low_usage_features(T.panel(spark, sf)))


@query("risk_features", "C-31", sel(PANEL + ",\n" + runs_sql("panel", "f <= 1e-12", "zr") + """,
a AS (SELECT *, f - lag(f) OVER w AS d, max(abs(f)) OVER (PARTITION BY series_id) + 1e-12 AS mx, f - avg(f) OVER (PARTITION BY series_id) AS c FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY day_idx)),
b AS (SELECT *, stddev_pop(d) OVER (PARTITION BY series_id) + 1e-12 AS sd, lag(c) OVER w AS cl, sum(c) OVER w AS cs, day_idx < (n_days // 7) * 7 AS ww,
  avg(f) FILTER (day_idx >= n_days - 90) OVER (PARTITION BY series_id) AS m90, stddev_pop(f) FILTER (day_idx >= n_days - 90) OVER (PARTITION BY series_id) AS s90,
  CASE WHEN day_idx < (n_days % 34) * (n_days // 34 + 1) THEN day_idx // (n_days // 34 + 1) ELSE n_days % 34 + (day_idx - (n_days % 34) * (n_days // 34 + 1)) // (n_days // 34) END AS seg
  FROM a WINDOW w AS (PARTITION BY series_id ORDER BY day_idx)),
g AS (SELECT series_id, any_value(m90) AS mean90, any_value(s90) ** 2 AS var90, regr_slope(f, day_idx) FILTER (day_idx >= n_days - 90) AS trend90,
  avg(((f - m90) / s90) ** 4) FILTER (day_idx >= n_days - 90) - 3 AS kurt90, avg(((f - m90) / s90) ** 3) FILTER (day_idx >= n_days - 90) AS skew90, (any_value(s90) + 1e-12) / (abs(any_value(m90)) + 1e-12) AS cv90,
  avg(f) FILTER (day_idx >= n_days - 7) / (avg(f) FILTER (day_idx >= n_days - 28) + 1e-12) AS week_month_ratio, avg((abs(d) < 0.01 * mx)::INT) AS flat, avg((abs(d) > 3 * sd)::INT) AS jump,
  sum(c * cl) / (sum(c * c) + 1e-12) AS autocorr, max(abs(cs)) / ((stddev_pop(f) + 1e-12) * sqrt(any_value(n_days))) AS cusum,
  avg(f) FILTER (ww AND day_idx % 7 < 5) / (avg(f) FILTER (ww AND day_idx % 7 >= 5) + 1e-12) AS weekday_weekend, greatest(""" + ", ".join(f"avg(f) FILTER (ww AND day_idx % 7 = {k})" for k in range(7)) + """) / (avg(f) FILTER (ww) + 1e-12) AS dow_max,
  avg(f) FILTER (ww AND day_idx % 7 >= 5) / (avg(f) FILTER (ww) + 1e-12) AS weekend_share, 1 - avg(is_missing::INT) AS p FROM b GROUP BY 1),
sg AS (SELECT series_id, seg, avg(f) AS a, stddev_pop(f) / (abs(avg(f)) + 1e-12) AS cv FROM b GROUP BY ALL),
s AS (SELECT series_id, avg(cv) AS month_cv, regr_slope(a, seg) AS month_trend FROM sg GROUP BY 1),
z AS (SELECT series_id, max(length) AS zero_run FROM zr GROUP BY 1)""", "g JOIN s USING (series_id) LEFT JOIN z USING (series_id)", "series_id, coalesce(zero_run, 0) AS zero_run",
                                    ["mean90", "var90", "trend90", "kurt90", "skew90", "cv90", "week_month_ratio", "flat", "jump", "autocorr", "cusum", "weekday_weekend", "dow_max", "weekend_share", "month_cv", "month_trend",
                                     ("greatest(p, 1 - p)", "max_prob"), ("abs(p - 0.5)", "margin"), ("-(p * ln(p + 1e-12) + (1 - p) * ln(1 - p + 1e-12))", "entropy")], 5))
def _(spark, sf):
    f = T.filled(spark, sf)
    p = f.groupBy("series_id").agg((1 - F.avg(F.col("is_missing").cast("double"))).alias("p"))
    return rounded(R.risk_features(f, p), 5)


CH = ["f", "volatility", "residual", "mask"]
_CHANNELS = STL + """,
chw AS (SELECT *, is_missing::INT AS mask, avg(f) OVER w AS m1, avg(f * f) OVER w AS m2 FROM stl WINDOW w AS (PARTITION BY series_id ORDER BY day_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
chan AS MATERIALIZED (SELECT series_id, day_idx, n_days, f, sqrt(greatest(m2 - m1 * m1, 0)) AS volatility, residual, mask::DOUBLE AS mask FROM chw)"""


def channels(spark, sf):
    x = C.seasonal_residual(T.filled(spark, sf))
    return x.withColumn("volatility", C.rolling_std("f")).withColumn("mask", F.col("is_missing").cast("double"))


@query("channel_features", "C-32", sel(_CHANNELS + ",\nlo AS (" + " UNION ALL ".join(f"SELECT series_id, day_idx, n_days, '{c}' AS channel, {c} AS v FROM chan" for c in CH) + """),
dm AS (SELECT *, v - avg(v) OVER (PARTITION BY series_id, channel) AS xm FROM lo),
lg AS (SELECT *, lag(xm, 1) OVER w AS l1, lag(xm, 7) OVER w AS l7, lag(xm, 30) OVER w AS l30 FROM dm WINDOW w AS (PARTITION BY series_id, channel ORDER BY day_idx))""",
                                       "lg GROUP BY ALL", "series_id, channel", [("avg(v)", "mean"), ("stddev_pop(v)", "std"), ("quantile_cont(v, 0.5)", "median"), ("min(v)", "min"), ("max(v)", "max"),
                                                                                 ("quantile_cont(v, 0.25)", "q25"), ("quantile_cont(v, 0.75)", "q75"),
                                                                                 ("avg(v) FILTER (day_idx >= n_days // 2) - avg(v) FILTER (day_idx < n_days // 2)", "half_change"),
                                                                                 ("avg((abs(v) < 1e-5)::INT)", "zero_ratio")] + [(f"avg(xm * l{k}) / (avg(xm * xm) + 1e-12)", f"acov_{k}") for k in (1, 7, 30)], 3))
def _(spark, sf):
    x = channels(spark, sf)
    # values within float noise of zero count as zero
    x = x.select("series_id", "day_idx", "n_days", *[F.when(F.abs(c) < 1e-5, 0.0).otherwise(F.col(c)).alias(c) for c in CH])
    return rounded(R.channel_features(x, CH), 3)


@query("channel_pairs", "C-32", sel(_CHANNELS, "chan GROUP BY 1", "series_id", [x for i, a in enumerate(CH) for b in CH[i + 1:] for x in (
    (f"avg({a} * {b})", f"{a}_{b}_prod"), (f"avg(({a} - {b}) ** 2)", f"{a}_{b}_sqdiff"))], 3))
def _(spark, sf):
    return rounded(R.channel_pairs(channels(spark, sf), CH), 3)


MEDFILL = PANEL + """,
pm AS (SELECT series_id, quantile_cont(value, 0.5) AS med FROM panel GROUP BY 1),
mf AS MATERIALIZED (SELECT p.* REPLACE (coalesce(p.value, pm.med, 0) AS f) FROM panel p JOIN pm USING (series_id))"""

MEANRANK = """sr AS (SELECT series_id, coalesce(avg(value), 0) AS m FROM panel GROUP BY 1),
gr AS (SELECT series_id, m, (rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0) / count(*) OVER () AS global_rank FROM sr)"""


@query("behaviour_profile", "C-33", sel(MEDFILL + ",\n" + MEANRANK + ",\n" + ma_sql("mf", "f", 7, "t7", "dv") + """,
q AS (SELECT series_id, quantile_cont(f, 0.1) AS p10, quantile_cont(f, 0.15) AS p15, quantile_cont(f, 0.25) FILTER (f > 0) AS a, quantile_cont(f, 0.5) FILTER (f > 0) AS b, quantile_cont(f, 0.75) FILTER (f > 0) AS c FROM mf GROUP BY 1),
x AS (SELECT dv.*, q.* EXCLUDE (series_id), f < greatest(p10 * 0.5, 0.01) AS anom FROM dv JOIN q USING (series_id)),
""" + runs_sql("x", "anom", "ar") + """,
rl AS (SELECT series_id, avg(length) AS mean_run_length FROM ar GROUP BY 1),
g AS (SELECT series_id, avg((f < 0.01)::INT) AS near_zero_ratio, avg((f < greatest(p15, 0.01))::INT) AS stable_low_ratio, stddev_pop(f) FILTER (f > 0) / (avg(f) FILTER (f > 0) + 1e-6) AS cv_daily, avg(anom::INT) AS anomaly_ratio,
  CASE WHEN count(*) FILTER (f > 0) > 20 AND any_value(c > a) THEN 1 - abs(count(*) FILTER (f > 0 AND f BETWEEN a AND b) - count(*) FILTER (f > 0 AND f BETWEEN b AND c))
    / greatest(count(*) FILTER (f > 0 AND f BETWEEN a AND b) + count(*) FILTER (f > 0 AND f BETWEEN b AND c), 1)::DOUBLE ELSE 0 END AS bimodality,
  stddev_pop(f - t7) FILTER (day_idx < n_days // 2) / (stddev_pop(f - t7) FILTER (day_idx >= n_days // 2) + 1e-6) AS half_deviation_ratio FROM x GROUP BY 1)""",
                                        "g JOIN gr USING (series_id) LEFT JOIN rl USING (series_id)", "series_id",
                                        ["near_zero_ratio", "stable_low_ratio", "cv_daily", "anomaly_ratio", "bimodality", "half_deviation_ratio", ("global_rank", "global_rank_pct"), ("coalesce(mean_run_length, 0)", "mean_run_length")]))
def _(spark, sf):
    return rounded(R.behaviour_profile(T.panel(spark, sf), series_means(spark, sf)))


@query("ljung_box", "C-34", sel(PANEL + ", lg AS (SELECT *, " + ", ".join(f"lag(f, {k}) OVER (PARTITION BY series_id ORDER BY day_idx) AS l{k}" for k in range(1, 11)) + """ FROM panel),
g AS (SELECT series_id, count(*) * (""" + " + ".join(f"coalesce(corr(f, l{k}), 0) ** 2" for k in range(1, 11)) + ") AS q FROM lg GROUP BY 1)", "g", "series_id",
    ["q", ("least(exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24), 1)", "p_value")], 5))
def _(spark, sf):
    return rounded(R.ljung_box(T.filled(spark, sf)), 5)


def cohorts(spark, sf):
    return S.tiers(series_means(spark, sf)).select("series_id", F.col("tier").alias("cohort"))


@query("cohort_features", "C-35", sel(PANEL + ",\n" + TIERS + """,
x AS (SELECT panel.*, tier FROM panel JOIN tiers USING (series_id)),
p15 AS (SELECT tier, quantile_cont(f, 0.15) AS p15 FROM x GROUP BY 1), cm AS (SELECT tier, day_idx, quantile_cont(f, 0.5) AS cmed FROM x GROUP BY ALL),
y AS (SELECT x.*, p15, f / (cmed + 1e-6) AS ratio, (rank() OVER (PARTITION BY series_id ORDER BY f) + (count(*) OVER (PARTITION BY series_id, f) - 1) / 2.0) / n_days AS rk FROM x JOIN p15 USING (tier) JOIN cm USING (tier, day_idx)),
g AS (SELECT series_id, avg((f < greatest(p15, 0.01))::INT) AS low_ratio, avg(f) FILTER (day_idx >= n_days - 30) / (avg(f) FILTER (day_idx < 800) + 1e-6) AS recent30, avg(f) FILTER (day_idx >= n_days - 90) / (avg(f) FILTER (day_idx < 800) + 1e-6) AS recent90,
  avg(ratio) AS peer_dev, avg((ratio < 0.5)::INT) AS peer_low, avg(rk) FILTER (day_idx >= n_days - 90) - avg(rk) FILTER (day_idx < 800) AS rank_drop FROM y GROUP BY 1),
mk AS (SELECT series_id, month(dt) AS m, f, row_number() OVER (PARTITION BY series_id, month(dt) ORDER BY day_idx) - 1 AS k, count(*) OVER (PARTITION BY series_id, month(dt)) // 2 AS h FROM panel),
my AS (SELECT series_id, m, coalesce(avg(f) FILTER (k < h), 0) AS y1, coalesce(avg(f) FILTER (k >= h), 0) AS y2 FROM mk GROUP BY ALL),
sc AS (SELECT series_id, avg(abs(y1 - y2) / greatest(y1, y2, 0.01)) AS seasonal_change FROM my GROUP BY 1)""", "g JOIN sc USING (series_id)", "series_id",
                                      "low_ratio, recent30, recent90, peer_dev, peer_low, rank_drop, seasonal_change", 2))
def _(spark, sf):
    return rounded(R.cohort_features(T.filled(spark, sf), cohorts(spark, sf), 800), 2)


_GAPS = """eg AS (SELECT series_id, pos - lag(pos) OVER (PARTITION BY series_id ORDER BY pos) AS gap FROM ox WHERE value > p95),
ev AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM eg WHERE gap IS NOT NULL),
cl AS (SELECT series_id, var_pop(gap) / (avg(gap) + 1e-6) ** 2 AS clustering FROM ev GROUP BY 1)"""
_OX = OBSERVED + """,
oq AS (SELECT series_id, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM observed GROUP BY 1),
gq AS (SELECT quantile_cont(value, 0.99) AS g99, quantile_cont(value, 0.999) AS g999 FROM observed),
ox AS (SELECT * FROM observed JOIN oq USING (series_id), gq)"""


@query("extreme_features", "C-36", sel(_OX + ",\n" + _GAPS + ", e1 AS (SELECT * FROM ev WHERE n > 1),\n" + hist_sql("e1", "gap", "series_id", "least(10, n)", "he") + """,
g AS (SELECT series_id, count(*) FILTER (value > p95) AS n_above_own_p95, count(*) FILTER (value > g99) AS n_above_global_p99, count(*) FILTER (value > g999) AS n_above_global_p999, count(*) FILTER (value > 10 * med) AS n_above_10x_median,
  max(value) / (any_value(med) + 1e-6) AS max_median_ratio, coalesce(sum(value) FILTER (value > p90), 0) / (sum(value) + 1e-6) AS extreme_sum_ratio,
  CASE WHEN count(*) FILTER (value > p90) > 3 THEN stddev_pop(value) FILTER (value > p90) / (avg(value) FILTER (value > p90) + 1e-6) ELSE 0 END AS extreme_cv, 1 - min(value) / (max(value) + 1e-6) AS max_to_min_range, any_value(p99) AS p99_value FROM ox GROUP BY 1)""",
                                       "g LEFT JOIN he USING (series_id) LEFT JOIN cl USING (series_id)", "series_id, n_above_own_p95, n_above_global_p99, n_above_global_p999, n_above_10x_median",
                                       ["max_median_ratio", "extreme_sum_ratio", "extreme_cv", "max_to_min_range", "p99_value", ("coalesce(entropy, 0)", "gap_entropy"), ("coalesce(clustering, 0)", "clustering")]))
def _(spark, sf):
    return rounded(R.extreme_features(T.observed(spark, sf)))


@query("extreme_clustering", "C-37", sel(_OX + ",\n" + _GAPS, "cl", "series_id", "clustering"))
def _(spark, sf):
    x = T.observed(spark, sf).withColumn("_p", F.percentile("value", 0.95).over(S.whole()))
    return rounded(R.clustering_index(R.event_gaps(x, F.col("value") > F.col("_p"), "pos")))


def mirrored_sql(src: str, v: str, w: int, out: str, cte: str) -> str:
    left, right = w // 2, w - w // 2 - 1
    return f"""{cte}_m AS (SELECT series_id, day_idx AS p, {v} AS v, true AS r FROM {src} UNION ALL SELECT series_id, -1 - day_idx, {v}, false FROM {src} WHERE day_idx < {left}
  UNION ALL SELECT series_id, 2 * n_days - 1 - day_idx, {v}, false FROM {src} WHERE day_idx >= n_days - {right}),
{cte}_a AS (SELECT series_id, p AS day_idx, r, avg(v) OVER (PARTITION BY series_id ORDER BY p ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING) AS {out} FROM {cte}_m),
{cte} AS (SELECT {src}.*, {out} FROM {src} JOIN {cte}_a a USING (series_id, day_idx) WHERE r)"""


@query("load_features", "C-38", sel(PANEL + ",\n" + mirrored_sql("panel", "f", 30, "rm", "rr") + """,
x AS (SELECT *, coalesce(lead(rm) OVER w - rm, 0) AS d, sum(c) OVER w AS cs FROM (SELECT *, f - avg(f) OVER (PARTITION BY series_id) AS c FROM rr) WINDOW w AS (PARTITION BY series_id ORDER BY day_idx)),
g AS (SELECT series_id, CASE WHEN count(value) >= 30 THEN avg(value) / (quantile_cont(value, 0.95) + 1e-6) ELSE 1 END AS load_factor, avg(f) FILTER (day_idx >= n_days * 3 // 4) / (avg(f) FILTER (day_idx < n_days * 3 // 4) + 1e-6) AS post_pre_ratio,
  min(d) AS max_drop_30d, max(d) AS max_spike_30d, max(abs(cs)) AS cusum_abs_max FROM x GROUP BY 1)""", "g", "series_id", "load_factor, post_pre_ratio, max_drop_30d, max_spike_30d, cusum_abs_max", 5))
def _(spark, sf):
    return rounded(R.load_features(T.panel(spark, sf)), 5)


@query("regime_stats", "C-39", sel(PANEL + """,
md AS (SELECT series_id, quantile_cont(value, 0.5) AS med FROM panel GROUP BY 1), pmd AS (SELECT panel.*, med FROM panel JOIN md USING (series_id)),
""" + runs_sql("pmd", "value < med", "lr") + """,
g AS (SELECT series_id, """ + ", ".join(f"avg(value) FILTER ({c}) AS {k}_mean, stddev_pop(value) FILTER ({c}) AS {k}_std, avg(is_missing::INT) FILTER ({c}) AS {k}_miss, count(*) FILTER ({c} AND value < 10) / greatest(count(value) FILTER ({c}), 1)::DOUBLE AS {k}_low"
                                          for k, c in (("pre", "day_idx < n_days * 3 // 4"), ("post", "day_idx >= n_days * 3 // 4"))) + """ FROM panel GROUP BY 1),
l AS (SELECT series_id, CASE WHEN max(length) >= 5 THEN max(length) ELSE 0 END AS low_run FROM lr GROUP BY 1)""", "g LEFT JOIN l USING (series_id)", "series_id, coalesce(low_run, 0) AS low_run",
    [f"{k}_{s}" for k in ("pre", "post") for s in ("mean", "std", "miss", "low")] + [("post_mean / (pre_mean + 1e-6)", "ratio_mean")]
    + [(f"CASE WHEN pre_{s} > 0 THEN post_{s} / (pre_{s} + 1e-6) WHEN post_{s} > 0 THEN 2 ELSE 1 END", f"ratio_{s}") for s in ("miss", "low")]))
def _(spark, sf):
    return rounded(R.regime_stats(T.panel(spark, sf)))


@query("drawdown", "C-39", sel(PANEL + """,
c AS (SELECT *, sum(f - mu) OVER (PARTITION BY series_id ORDER BY day_idx) AS cs FROM (SELECT *, avg(f) OVER (PARTITION BY series_id) AS mu FROM panel)),
m AS (SELECT *, max(cs) OVER (PARTITION BY series_id ORDER BY day_idx) AS top FROM c)""", "m GROUP BY 1",
                               "series_id, arg_min(day_idx, struct_pack(a := -round(top - cs, 6), b := day_idx)) AS drawdown_day", [("max(top - cs)", "max_drawdown"), ("max(top - cs) / (max(top) + 1e-6)", "drawdown_share")], 4))
def _(spark, sf):
    x = T.filled(spark, sf).withColumn("dev", F.col("f") - F.avg("f").over(S.whole()))
    return rounded(R.drawdown(x, "dev"), 4)


@query("log_scale_stats", "C-40", sel(PANEL, "panel GROUP BY 1", "series_id", [("avg(ln(1 + f))", "log_mean"), ("stddev_pop(ln(1 + f))", "log_std"), ("max(ln(1 + f))", "log_max"), ("quantile_cont(ln(1 + f), 0.5)", "log_median"),
                                                                              ("avg((f = 0)::INT)", "zero_ratio"), ("avg((f < 1)::INT)", "below_1_ratio")]))
def _(spark, sf):
    return rounded(R.log_scale_stats(T.filled(spark, sf)))


COMPACT = MEDFILL + ",\n" + MEANRANK + ",\n" + TIERS.replace("sm AS", "sm AS").replace("q[", "q[") + ",\n" + ma_sql("mf", "f", 7, "t7", "c0") + """,
c1 AS (SELECT *, f - avg(f) OVER (PARTITION BY series_id) AS c, (f - avg(f) OVER (PARTITION BY series_id)) ** 2 AS c2 FROM c0),
""" + mirrored_sql("c1", "c2", 60, "rv", "c3") + """,
q AS (SELECT series_id, quantile_cont(f, 0.1) AS p10, avg(value) FILTER (day_idx >= n_days // 2) AS sm2 FROM mf GROUP BY 1),
c4 AS (SELECT c3.*, p10, sm2, f - t7 AS res, sum(c) OVER w AS cs, lag(f, 1) OVER w AS l1, lag(f, 7) OVER w AS l7, f < greatest(p10 * 0.5, 0.01) AS anom FROM c3 JOIN q USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY day_idx)),
c5 AS (SELECT *, avg(res) OVER (PARTITION BY series_id) AS rmu, stddev_pop(res) OVER (PARTITION BY series_id) AS rsd FROM c4),
g AS (SELECT series_id, avg(value) AS mean, stddev_pop(value) AS std, stddev_pop(value) / (avg(value) + 1e-6) AS cv, avg(coalesce((value < 10)::INT, 0)) AS low_rate, avg(is_missing::INT) AS miss_rate,
  avg(value) FILTER (day_idx >= n_days // 2) / (avg(value) FILTER (day_idx < n_days // 2) + 1e-6) AS change_ratio, avg(coalesce((value < sm2 * 1.5)::INT, 0)) FILTER (day_idx >= n_days // 2) AS change_persistence,
  max(abs(cs)) / (avg(sqrt(rv + 1e-6)) + 1e-6) AS cusum_score, avg(anom::INT) AS anomaly_ratio, stddev_pop(anom::INT) AS anom_std, coalesce(corr(f, l1), 0) AS acf1, coalesce(corr(f, l7), 0) AS acf7,
  stddev_pop(res) / (stddev_pop(f) + 1e-6) AS res_std, avg(((res - rmu) / rsd) ** 3) AS res_skew, avg((f < 0.01)::INT) AS near_zero FROM c5 GROUP BY 1),
mc AS (SELECT series_id, month(dt) AS m, stddev_pop(f) / (avg(f) + 1e-6) AS cv FROM mf GROUP BY ALL HAVING count(*) > 5),
mm AS (SELECT series_id, avg(cv) AS monthly_cv, max(cv) - min(cv) AS monthly_range FROM mc GROUP BY 1),
pd AS (SELECT tier, quantile_cont(m, 0.5) AS pm FROM tiers GROUP BY 1),
compact AS MATERIALIZED (SELECT g.*, monthly_cv, monthly_range, global_rank, g.mean / (pm + 1e-6) AS peer_dev FROM g JOIN mm USING (series_id) JOIN gr USING (series_id) JOIN tiers ON tiers.series_id = g.series_id JOIN pd USING (tier))"""


@query("compact_behaviour", "C-41", sel(COMPACT, "compact", "series_id", "mean, std, cv, low_rate, miss_rate, change_ratio, change_persistence, cusum_score, anomaly_ratio, anom_std, acf1, acf7, res_std, res_skew, near_zero, monthly_cv, monthly_range, global_rank, peer_dev", 5))
def _(spark, sf):
    return rounded(R.compact_behaviour(T.panel(spark, sf), cohorts(spark, sf), series_means(spark, sf)), 5)
