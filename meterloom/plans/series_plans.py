"""Per-series aggregate features (inventory C-1 .. C-22)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import peaks, series_stats as S
from ..sources import tables as T
from .catalog import query
from .sqlbase import OBSERVED, PANEL, READINGS, sel

E = "1e-8"


@query("basic_stats", "C-1", sel(OBSERVED + """,
m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY series_id) AS med FROM observed),
g AS (SELECT series_id, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS var, any_value(med) AS median,
  avg(abs(value - med)) AS mad, max(value) - min(value) AS range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
  max(value) AS max, min(value) AS min FROM m GROUP BY 1)""", "g", "series_id",
                                  ["mean", "std", "var", (f"least(greatest(std / (mean + {E}), 0), 20)", "cv"), "median", "mad", "range", "iqr", "max", "min",
                                   (f"max / (mean + {E})", "max_mean_ratio"), (f"min / (mean + {E})", "min_mean_ratio"), (f"max / (min + {E})", "max_min_ratio")]))
def _(spark, sf):
    return rounded(S.basic(T.observed(spark, sf)))


@query("percentile_block", "C-2", sel(READINGS + ", q AS (SELECT series_id, " + ", ".join(
    f"quantile_cont(value, {p / 100}) AS q{p}" for p in S.PCTS) + " FROM readings GROUP BY 1)", "q", "series_id",
    [f"q{p}" for p in S.PCTS] + [(f"q95 / (q5 + {E})", "q95_q05"), (f"q90 / (q10 + {E})", "q90_q10"), ("q50 - q25", "q50_q25"), ("q75 - q50", "q75_q50")]))
def _(spark, sf):
    return rounded(S.percentiles(T.readings(spark, sf)))


@query("moments", "C-3", sel(READINGS + """,
m AS (SELECT *, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd FROM readings WINDOW w AS (PARTITION BY series_id))""",
                             "m GROUP BY 1", "series_id", [("avg(((value - mu) / sd) ** 3)", "skew"), ("avg(((value - mu) / sd) ** 4) - 3", "kurt")]))
def _(spark, sf):
    return rounded(S.moments(T.readings(spark, sf)))


@query("threshold_ratios", "C-4", sel(READINGS, "readings GROUP BY 1", "series_id",
                                      [(f"avg((value > {t})::INT)", f"above_{t}") for t in (10, 20, 30, 50, 100)]
                                      + [(f"avg((value < {t})::INT)", f"below_{t}") for t in (5, 10, 20)]))
def _(spark, sf):
    return rounded(S.threshold_ratios(T.readings(spark, sf)))


@query("tail_means", "C-5", sel(READINGS + """,
q AS (SELECT series_id, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM readings GROUP BY 1)""",
                                "readings JOIN q USING (series_id) GROUP BY 1", "series_id",
                                [("avg(value) FILTER (value >= b)", "top5_mean"), ("avg(value) FILTER (value <= a)", "bottom5_mean")]))
def _(spark, sf):
    return rounded(S.tail_means(T.readings(spark, sf)))


@query("difference_stats", "C-6", sel(OBSERVED + """,
d AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS d FROM observed),
s AS (SELECT *, sign(d) <> lag(sign(d)) OVER (PARTITION BY series_id ORDER BY pos) AS ch FROM d)""", "s GROUP BY 1", "series_id",
                                      [("avg(d)", "diff_mean"), ("stddev_pop(d)", "diff_std"), ("avg(abs(d))", "diff_abs_mean"), ("max(abs(d))", "diff_abs_max"),
                                       ("quantile_cont(abs(d), 0.75)", "diff_q75"), ("quantile_cont(abs(d), 0.9)", "diff_q90"),
                                       (f"count(*) FILTER (ch) / (count(d) + {E})", "sign_change_ratio"), ("avg((d > 0)::INT)", "positive_ratio"), ("1 - avg((d > 0)::INT)", "negative_ratio")]))
def _(spark, sf):
    return rounded(S.differences(T.observed(spark, sf)))


@query("peak_counts", "C-7", sel(OBSERVED + """,
pv AS (SELECT series_id, side, pos AS x0, value * side AS v FROM observed, (VALUES (1), (-1)) t(side)),
pr AS (SELECT series_id, side, run, any_value(v) AS v, min(x0) AS a, max(x0) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY series_id, side ORDER BY x0) AS run FROM (
  SELECT *, coalesce(v <> lag(v) OVER (PARTITION BY series_id, side ORDER BY x0), true)::INT AS new FROM pv)) GROUP BY series_id, side, run),
pk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id, side ORDER BY v DESC, x0 DESC) AS rk FROM (
  SELECT series_id, side, v, (a + z) // 2 AS x0 FROM (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS c FROM pr WINDOW w AS (PARTITION BY series_id, side ORDER BY run)) WHERE v > b AND v > c)),
ps AS (SELECT DISTINCT series_id, side, 0::BIGINT AS rk, []::HUGEINT[] AS kept FROM pk
  UNION ALL SELECT pk.series_id, pk.side, pk.rk, CASE WHEN len(list_filter(kept, lambda o: abs(o - pk.x0) < 7)) = 0 THEN list_append(kept, pk.x0::HUGEINT) ELSE kept END
  FROM ps JOIN pk ON pk.series_id = ps.series_id AND pk.side = ps.side AND pk.rk = ps.rk + 1),
pc AS (SELECT series_id, side, len(arg_max(kept, rk)) AS c FROM ps GROUP BY 1, 2),
pn AS (SELECT series_id, count(*) AS n FROM observed GROUP BY 1)""", "pn LEFT JOIN pc u ON u.series_id = pn.series_id AND u.side = 1 LEFT JOIN pc d ON d.series_id = pn.series_id AND d.side = -1",
                                "pn.series_id, CAST(coalesce(u.c, 0) AS INTEGER) AS n_peaks, CAST(coalesce(d.c, 0) AS INTEGER) AS n_valleys", [("coalesce(u.c, 0) / (pn.n + 1e-8)", "peak_ratio")], recursive=True))
def _(spark, sf):
    return rounded(peaks.peak_features(T.observed(spark, sf)))


@query("trend_features", "C-8", sel(OBSERVED + """,
g AS (SELECT series_id, any_value(n) AS n, regr_slope(value, pos) AS slope, regr_r2(value, pos) AS r2,
  regr_syy(value, pos) AS syy, regr_sxx(value, pos) AS sxx,
  regr_slope(value, pos) FILTER (pos < n // 3) AS s1, regr_slope(value, pos) FILTER (pos >= n // 3 AND pos < (2 * n) // 3) AS s2,
  regr_slope(value, pos) FILTER (pos >= (2 * n) // 3) AS s3, avg(value) FILTER (pos < 7) AS a, avg(value) FILTER (pos >= n - 7) AS b
  FROM observed GROUP BY 1)""", "g", "series_id",
                                    ["slope", "r2", ("sqrt((1 - r2) * syy / sxx / (n - 2))", "std_err"), ("s1", "slope_first"), ("s2", "slope_mid"), ("s3", "slope_last"),
                                     ("s3 - s1", "acceleration"), ("a", "mean_first7"), ("b", "mean_last7"), ("b - a", "mean_change7")]))
def _(spark, sf):
    return rounded(S.trend(T.observed(spark, sf)))


def runs_sql(src: str, pred: str, cte: str) -> str:
    """CTE `cte`(series_id, start, length): maximal runs of `pred` in `src`."""
    return f"""{cte}_i AS (SELECT series_id, day_idx, day_idx - row_number() OVER (PARTITION BY series_id ORDER BY day_idx) AS isl FROM {src} WHERE {pred}),
{cte} AS (SELECT series_id, min(day_idx) AS start, count(*) AS length FROM {cte}_i GROUP BY series_id, isl)"""


@query("zero_missing_stats", "C-9", sel(PANEL + ",\n" + runs_sql("panel", "is_missing", "gaps") + ",\n" + runs_sql("panel", "f = 0", "zeros") + """,
b AS (SELECT series_id, avg((f = 0)::INT) AS zero_ratio, avg((f < 1)::INT) AS below_1_ratio, avg(is_missing::INT) AS missing_ratio FROM panel GROUP BY 1),
gg AS (SELECT series_id, count(*) AS gap_count, max(length) AS gap_longest FROM gaps GROUP BY 1), zz AS (SELECT series_id, max(length) AS zero_longest FROM zeros GROUP BY 1)""",
                                        "b LEFT JOIN gg USING (series_id) LEFT JOIN zz USING (series_id)",
                                        "series_id, coalesce(gap_count, 0) AS gap_count, coalesce(gap_longest, 0) AS gap_longest, coalesce(zero_longest, 0) AS zero_longest",
                                        "zero_ratio, below_1_ratio, missing_ratio"))
def _(spark, sf):
    return rounded(S.zero_missing(T.filled(spark, sf)))


@query("recent_window_stats", "C-10", sel(PANEL, "panel GROUP BY 1", "series_id", [
    (f"{fn} FILTER (day_idx >= n_days - {d})" if "-" not in fn else f"max(f) FILTER (day_idx >= n_days - {d}) - min(f) FILTER (day_idx >= n_days - {d})", f"{n}_{d}")
    for d in (7, 14, 30, 60) for n, fn in (("mean", "avg(f)"), ("std", "stddev_pop(f)"), ("max", "max(f)"), ("min", "min(f)"), ("range", "-"))]))
def _(spark, sf):
    return rounded(S.recent(T.filled(spark, sf)))


@query("holiday_features", "C-11", sel(PANEL + """,
h AS (SELECT *, (month(dt) = 1 AND day(dt) >= 28) OR (month(dt) = 2 AND day(dt) <= 15) AS sp, month(dt) = 10 AND day(dt) <= 7 AS na,
  month(dt) = 1 AND day(dt) <= 25 AS pre FROM panel),
g AS (SELECT series_id, coalesce(avg(f) FILTER (sp AND f > 0), 0) AS spring_mean, avg((f = 0)::INT) FILTER (sp) AS spring_zero_ratio,
  coalesce(avg(f) FILTER (pre AND f > 0), 1) AS pm, coalesce(avg(f) FILTER (na AND f > 0), 0) AS national_mean, avg((f = 0)::INT) FILTER (na) AS national_zero_ratio,
  avg((f = 0)::INT) FILTER (sp OR na) AS holiday_zero_ratio, coalesce(avg(f) FILTER ((sp OR na) AND f > 0), 0) AS holiday_mean FROM h GROUP BY 1)""",
                                       "g", "series_id", ["spring_mean", "spring_zero_ratio", "national_mean", "national_zero_ratio", "holiday_zero_ratio", "holiday_mean",
                                                          (f"spring_mean / (pm + {E})", "spring_ratio")]))
def _(spark, sf):
    return rounded(S.holidays(T.filled(spark, sf)))


@query("monthly_means", "C-12", sel(READINGS + """,
mm AS (SELECT series_id, m, coalesce(avg(value) FILTER (month(dt) = m), 0) AS a FROM readings, range(1, 13) t(m) GROUP BY ALL),
oo AS (SELECT series_id, coalesce(avg(a) FILTER (a > 0), 1) AS o FROM mm GROUP BY 1)""", "mm JOIN oo USING (series_id) GROUP BY 1", "series_id",
                                    [(f"max(a) FILTER (m = {m})", f"month_{m}") for m in range(1, 13)] + [(f"max(a / (o + {E})) FILTER (m = {m})", f"month_ratio_{m}") for m in range(1, 13)]))
def _(spark, sf):
    return rounded(S.monthly_means(T.readings(spark, sf)))


@query("monthly_cv", "C-13", sel(PANEL + f""",
c AS (SELECT series_id, month(dt) AS m, stddev_pop(f) / (avg(f) + {E}) AS cv FROM panel GROUP BY ALL HAVING count(*) > 1)""", "c GROUP BY 1", "series_id",
                                 [("avg(cv)", "monthly_cv_mean"), ("stddev_pop(cv)", "monthly_cv_std")]))
def _(spark, sf):
    return rounded(S.monthly_cv(T.filled(spark, sf)))


@query("weekday_weekend_ratio", "C-14", sel(PANEL, "panel GROUP BY 1", "series_id", [
    (f"avg(f) FILTER (isodow(dt) <= 5) / (avg(f) FILTER (isodow(dt) > 5) + {E})", "weekday_weekend_ratio")]))
def _(spark, sf):
    return rounded(S.weekday_ratio(T.filled(spark, sf)))


@query("absolute_deviation", "C-15", sel(READINGS + ", d AS (SELECT series_id, abs(value - avg(value) OVER (PARTITION BY series_id)) AS a FROM readings)",
                                         "d GROUP BY 1", "series_id", [("max(a)", "abs_dev_max"), ("avg(a)", "abs_dev_mean")]))
def _(spark, sf):
    return rounded(S.absolute_deviation(T.readings(spark, sf)))


def _lags(src: str, v: str, order: str, lags) -> str:
    return "lg AS (SELECT *, " + ", ".join(f"lag({v}, {k}) OVER (PARTITION BY series_id ORDER BY {order}) AS l{k}" for k in lags) + f" FROM {src})"


@query("autocorrelation", "C-16", sel(OBSERVED + ",\n" + _lags("observed", "value", "pos", (1, 7, 30)), "lg GROUP BY 1", "series_id",
                                      [(f"CASE WHEN count(*) > greatest(20, {k}) THEN coalesce(corr(value, l{k}), 0) ELSE 0 END", f"autocorr_{k}") for k in (1, 7, 30)]))
def _(spark, sf):
    return rounded(S.autocorrelation(T.observed(spark, sf)))


@query("masked_autocorrelation", "C-17", sel(OBSERVED.replace("WHERE value IS NOT NULL", "WHERE value >= 30") + ",\n" + _lags("observed", "value", "pos", (7, 14, 30)), "lg GROUP BY 1", "series_id",
                                             [(f"CASE WHEN count(*) >= {k} + 5 THEN coalesce(corr(value, l{k}), 0) ELSE 0 END", f"autocorr_{k}") for k in (7, 14, 30)]))
def _(spark, sf):
    return rounded(S.autocorrelation(T.observed(spark, sf, "value >= 30"), lags=(7, 14, 30), min_extra=5))


@query("autocovariance_ratio", "C-18", sel(PANEL + ", dm AS (SELECT *, f - avg(f) OVER (PARTITION BY series_id) AS xm FROM panel),\n" + _lags("dm", "xm", "day_idx", (1, 7, 30)),
                                           "lg GROUP BY 1", "series_id", [(f"avg(xm * l{k}) / (avg(xm * xm) + 1e-12)", f"acov_{k}") for k in (1, 7, 30)]))
def _(spark, sf):
    return rounded(S.autocovariance_ratio(T.filled(spark, sf)))


@query("regularity_flags", "C-19", sel(OBSERVED + f""",
d AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS d FROM observed),
s AS (SELECT series_id, avg(d) AS dm, stddev_pop(d) AS ds, quantile_cont(value, 0.1) AS p10 FROM d GROUP BY 1)""", "d JOIN s USING (series_id) GROUP BY 1", "series_id",
                                       [(f"1 / (any_value(ds) + {E})", "flatness"), (f"avg((abs(d - dm) > 3 * (ds + {E}))::INT)", "sudden_change_ratio"),
                                        (f"count(*) FILTER (value < p10) / (count(*) + {E})", "low_day_ratio")]))
def _(spark, sf):
    return rounded(S.regularity_flags(T.observed(spark, sf)))


@query("zero_runs", "C-20", sel(PANEL + ",\n" + runs_sql("panel", "f = 0", "zr") + f""",
mm AS (SELECT series_id, month(dt) AS m, avg(value) AS a FROM panel WHERE value IS NOT NULL GROUP BY ALL),
me AS (SELECT series_id, CASE WHEN count(*) > 3 THEN max(a) / (min(a) + {E}) ELSE 1 END AS monthly_max_min_ratio,
  CASE WHEN count(*) > 3 THEN stddev_pop(a) / (avg(a) + {E}) ELSE 0 END AS monthly_std_norm FROM mm GROUP BY 1),
z AS (SELECT series_id, count(*) AS zero_run_count, max(length) AS zero_run_longest FROM zr GROUP BY 1)""", "me LEFT JOIN z USING (series_id)",
                                "series_id, coalesce(zero_run_count, 0) AS zero_run_count, coalesce(zero_run_longest, 0) AS zero_run_longest", "monthly_max_min_ratio, monthly_std_norm"))
def _(spark, sf):
    return rounded(S.zero_runs(T.filled(spark, sf)))


TIERS = """sm AS (SELECT series_id, avg(value) AS m FROM readings GROUP BY 1),
tb AS (SELECT quantile_cont(m, [0.2, 0.4, 0.6, 0.8]) AS q FROM sm WHERE m > 0),
tiers AS (SELECT series_id, m, CAST(CASE WHEN m <= 0 THEN 0 WHEN m <= q[1] THEN 1 WHEN m <= q[2] THEN 2 WHEN m <= q[3] THEN 3
  WHEN m <= q[4] THEN 4 ELSE 5 END AS INTEGER) AS tier FROM sm, tb)"""


def series_means(spark, sf):
    return T.readings(spark, sf).groupBy("series_id").agg(F.avg("value").alias("m"))


@query("consumption_tier", "C-21", sel(READINGS + ",\n" + TIERS, "tiers", "series_id, tier, " + ", ".join(f"CAST(tier = {k} AS INTEGER) AS tier_{k}" for k in range(1, 6)), "m"))
def _(spark, sf):
    return rounded(S.tiers(series_means(spark, sf)))


@query("yearly_drift", "C-22", sel(READINGS + """,
y AS (SELECT series_id, CAST(month(dt) AS INTEGER) AS month, year(dt) AS y, avg(value) AS m, count(*) AS c FROM readings GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rk, lag(m) OVER w AS prev FROM y WINDOW w AS (PARTITION BY series_id, month ORDER BY y)),
g AS (SELECT series_id, month, sum(c) AS c, count(*) AS n, avg(m) AS a, stddev_pop(m) AS s, regr_slope(m, rk) AS b, max((prev - m) / (prev + 1e-6)) AS d FROM r GROUP BY ALL)""",
                                   "g", "series_id, month", [("CASE WHEN c >= 10 AND n >= 2 AND a > 0.1 THEN s / a ELSE 0 END", "yoy_cv"), ("CASE WHEN c >= 10 AND n >= 2 AND s > 0 THEN b / (a + 1e-6) ELSE 0 END", "yoy_trend"),
                                                             ("CASE WHEN c >= 10 AND n >= 2 THEN greatest(d, 0) ELSE 0 END", "yoy_drop")]))
def _(spark, sf):
    return rounded(S.yearly_drift(T.readings(spark, sf)))
