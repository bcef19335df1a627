"""Complexity (E), runs and change-points (F), spectra (G)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import clean as C, complexity as X, panel as P, runs as RU, spectral as G
from ..sources import tables as T
from .catalog import query
from .panel_plans import WEEKS, ma_sql
from .series_plans import runs_sql
from .sqlbase import OBSERVED, PANEL, READINGS, sel

# ---------------------------------------------------------------- E


@query("sample_entropy", "E-1", sel(OBSERVED + """,
th AS (SELECT series_id, value AS x, CAST(pos AS BIGINT) AS i FROM observed),
tn AS (SELECT series_id, count(*) AS n, 0.2 * stddev_pop(x) AS r FROM th GROUP BY 1),
tv AS (SELECT th.*, n, r, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM th JOIN tn USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY i)),
pc AS (SELECT a.series_id, count(*) FILTER (abs(a.x - b.x) < a.r AND abs(a.x1 - b.x1) < a.r AND a.i < a.n - 2 AND b.i < a.n - 2) AS nb,
  count(*) FILTER (abs(a.x - b.x) < a.r AND abs(a.x1 - b.x1) < a.r AND abs(a.x2 - b.x2) < a.r AND a.i < a.n - 3 AND b.i < a.n - 3) AS na FROM tv a JOIN tv b ON a.series_id = b.series_id AND a.i < b.i GROUP BY 1)""", "pc", "series_id", [("CASE WHEN na > 0 AND nb > 0 THEN -ln(na / nb::DOUBLE) ELSE 0 END", "sample_entropy")], 5))
def _(spark, sf):
    return rounded(X.sample_entropy(T.observed(spark, sf)), 5)


def _ranks(order: int) -> str:
    out = []
    for a in range(order):
        out.append("(" + " + ".join(f"(x{b} {'<=' if b < a else '<'} x{a})::INT" for b in range(order) if b != a) + ")")
    return " || '-' || ".join(out)


@query("permutation_entropy", "E-2", sel(OBSERVED + ", l AS (SELECT series_id, value AS x0, " + ", ".join(f"lead(value, {j}) OVER (PARTITION BY series_id ORDER BY pos) AS x{j}" for j in (1, 2, 3)) + f""" FROM observed),
p AS (SELECT series_id, {_ranks(4)} AS pat, count(*) AS c FROM l WHERE x3 IS NOT NULL GROUP BY ALL),
q AS (SELECT series_id, c / sum(c) OVER (PARTITION BY series_id) AS q, count(*) OVER (PARTITION BY series_id) AS k FROM p)""", "q GROUP BY 1", "series_id", [("sum(-q * ln(q)) / ln(any_value(k))", "perm_entropy")]))
def _(spark, sf):
    return rounded(X.permutation_entropy(T.observed(spark, sf)))


@query("lempel_ziv", "E-3", sel(OBSERVED + """,
ed AS (SELECT series_id, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS e, min(value) < max(value) AS varied FROM observed GROUP BY 1),
tx AS (SELECT series_id, string_agg(chr(97 + CAST(len(list_filter(e, lambda x: x <= value)) AS INTEGER)), '' ORDER BY pos) AS t, any_value(n) AS n, any_value(varied) AS varied FROM observed JOIN ed USING (series_id) GROUP BY 1),
lz AS (SELECT series_id, t, n, 0 AS pos_at, 1 AS size, 0 AS ph, false AS grow FROM tx WHERE n >= 10 AND varied
  UNION ALL SELECT series_id, t, n, CASE WHEN g THEN pos_at ELSE pos_at + size END, CASE WHEN g THEN size + 1 ELSE 1 END, CASE WHEN g THEN ph ELSE ph + 1 END, g FROM (SELECT *, pos_at + size <= n AND contains(left(t, pos_at + size - 1), substr(t, pos_at + 1, size)) AS g FROM lz WHERE pos_at < n)),
fi AS (SELECT series_id, ph / (n / log2(n)) AS c FROM lz WHERE pos_at >= n)""", "tx LEFT JOIN fi USING (series_id)", "series_id", [("coalesce(c, 0)", "lz_complexity")], recursive=True))
def _(spark, sf):
    return rounded(X.lempel_ziv(T.observed(spark, sf)))


@query("tail_shape", "E-4", sel(READINGS + """,
q AS (SELECT series_id, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM readings GROUP BY 1),
e AS (SELECT series_id, any_value(p90) AS p90, any_value(p95) AS p95, any_value(p99) AS p99, avg(value - p90) FILTER (value > p90) AS m, var_pop(value - p90) FILTER (value > p90) AS v, count(*) FILTER (value > p90) AS k, count(*) AS n
  FROM readings JOIN q USING (series_id) GROUP BY 1)""", "e", "series_id", [("0.5 * (1 - m * m / v)", "tail_shape"), ("0.5 * m * (1 + m * m / v)", "tail_scale"), ("(p99 - p95) / (p95 - p90 + 1e-6)", "tail_ratio"), ("k / n::DOUBLE", "exceedance_ratio")]))
def _(spark, sf):
    return rounded(X.tail_shape(T.readings(spark, sf)))


@query("distribution_shape", "E-5", sel(OBSERVED + """,
o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value) AS i, avg(value) OVER s AS mu, stddev_pop(value) OVER s AS sd, avg(ln(value + 1e-6)) OVER s AS lm, stddev_pop(ln(value + 1e-6)) OVER s AS ls, min(value) OVER s AS lo, max(value) OVER s AS hi, least(50, n // 5) AS b
  FROM observed WINDOW s AS (PARTITION BY series_id)),
oc AS (SELECT *, least(floor((value - lo) * b / (hi - lo)), b - 1) AS c, (hi - lo) / b AS wd FROM o),
h AS (SELECT series_id, c, count(*) / any_value(n * wd) AS dens, any_value(lo + (c + 0.5) * wd) AS mid, any_value(mu) AS mu, any_value(sd) AS sd, any_value(lm) AS lm, any_value(ls) AS ls, any_value(b) AS b FROM oc GROUP BY series_id, c),
hh AS (SELECT series_id, sqrt(greatest(0, 1 - sum(sqrt(dens * exp(-pow((mid - mu) / (sd + 1e-6), 2) / 2) / ((sd + 1e-6) * sqrt(2 * pi())) + 1e-10)) - (any_value(b) - count(*)) * 1e-5)) AS hellinger_normal,
  sqrt(greatest(0, 1 - sum(sqrt(dens * exp(-pow((ln(mid) - lm) / ls, 2) / 2) / (mid * ls * sqrt(2 * pi())) + 1e-10)) - (any_value(b) - count(*)) * 1e-5)) AS hellinger_lognormal FROM h GROUP BY 1),
g AS (SELECT series_id, (2 * sum(i * value) - (count(*) + 1) * sum(value)) / (count(*) * sum(value) + 1e-6) AS gini, count(*) AS n, avg(((value - mu) / sd) ** 3) AS sk, avg(((value - mu) / sd) ** 4) - 3 AS ku,
  quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS c FROM o GROUP BY 1),
ms AS (SELECT series_id, avg((value <= m)::INT) AS mass_below_median FROM o JOIN g USING (series_id) GROUP BY 1)""", "g JOIN hh USING (series_id) JOIN ms USING (series_id)", "series_id",
                                        ["gini", "hellinger_normal", "hellinger_lognormal", ("(sk * sk + 1) / (ku + 3 * (n - 1)::DOUBLE ** 2 / ((n - 2) * (n - 3)) + 1e-6)", "bimodality"), ("(c - a) / (m + 1e-6)", "spread_ratio"), "mass_below_median"]))
def _(spark, sf):
    return rounded(X.distribution_shape(T.observed(spark, sf)))


@query("burstiness", "E-6", sel(OBSERVED + """,
m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY series_id) AS med, row_number() OVER (PARTITION BY series_id ORDER BY value DESC) AS r FROM observed),
e AS (SELECT series_id, pos, pos - lag(pos) OVER (PARTITION BY series_id ORDER BY pos) AS gap FROM m WHERE value > med),
f AS (SELECT *, lag(gap) OVER (PARTITION BY series_id ORDER BY pos) AS lg FROM e),
b AS (SELECT series_id, stddev_pop(gap) / (avg(gap) + 1e-6) AS cv, coalesce(corr(gap, lg), 0) AS memory FROM f GROUP BY 1),
c AS (SELECT series_id, sum(value) FILTER (r <= greatest(1, n // 10)) / sum(value) AS concentration FROM m GROUP BY 1)""", "b JOIN c USING (series_id)", "series_id", [("(cv - 1) / (cv + 1)", "burstiness"), "memory", "concentration"]))
def _(spark, sf):
    return rounded(X.burstiness(T.observed(spark, sf)))


@query("hurst_dfa", "E-7", sel(OBSERVED + """,
y AS (SELECT *, sum(value - mu) OVER (PARTITION BY series_id ORDER BY pos) AS y FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS mu FROM observed)),
sc AS (SELECT DISTINCT series_id, n, CAST(floor(10.0 ** (1 + i * (log10(n // 4) - 1) / 9.0) + 1e-9) AS INTEGER) AS s FROM observed, range(10) t(i)),
sg AS (SELECT y.series_id, s, pos // s AS g, (regr_syy(y, pos) - regr_sxy(y, pos) ** 2 / regr_sxx(y, pos)) / count(*) AS e FROM y JOIN sc ON sc.series_id = y.series_id AND s >= 10 AND s <= y.n // 4 AND pos // s < y.n // s GROUP BY ALL),
f AS (SELECT series_id, s, sqrt(avg(e)) AS f FROM sg GROUP BY ALL)""", "f GROUP BY 1", "series_id", [("regr_slope(ln(f + 1e-10), ln(s))", "hurst")]))
def _(spark, sf):
    return rounded(X.hurst_dfa(T.observed(spark, sf)))


@query("time_asymmetry", "E-8", sel(OBSERVED + """,
q AS (SELECT series_id, """ + ", ".join(f"quantile_cont(value, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM observed GROUP BY 1),\ns AS (SELECT series_id, pos, " + " + ".join(f"(e{i} <= value)::INT" for i in range(1, 10)) + """ AS s FROM observed JOIN q USING (series_id)),
t AS (SELECT *, lead(s) OVER (PARTITION BY series_id ORDER BY pos) AS t FROM s),
c AS (SELECT series_id, s AS a, t AS b, count(*) AS c FROM t WHERE t IS NOT NULL GROUP BY ALL),
f AS (SELECT series_id, a, b, c / (sum(c) OVER (PARTITION BY series_id, a) + 1e-10) AS f FROM c), r AS (SELECT series_id, b AS a, a AS b, c / (sum(c) OVER (PARTITION BY series_id, b) + 1e-10) AS r FROM c),
m AS (SELECT coalesce(f.series_id, r.series_id) AS series_id, coalesce(f.a, r.a) AS a, coalesce(f.b, r.b) AS b, coalesce(f, 0) AS f, coalesce(r, 0) AS r FROM f FULL JOIN r ON f.series_id = r.series_id AND f.a = r.a AND f.b = r.b),
rw AS (SELECT series_id, a, sum(abs(f - r)) AS d, sum(f) FILTER (b > a) AS u, sum(f) FILTER (b < a) AS l, abs(sum(f) - sum(r)) AS s FROM m GROUP BY ALL)""", "rw GROUP BY 1", "series_id",
                                    [("sum(d) / 20", "asymmetry"), ("sum(u)", "up_mass"), ("sum(l)", "down_mass"), ("sum(u) / (sum(l) + 1e-6)", "up_down_ratio"), ("max(s)", "row_asymmetry")]))
def _(spark, sf):
    return rounded(X.time_asymmetry(T.observed(spark, sf)))


@query("symbol_features", "E-10", sel(PANEL + """,
wk AS (SELECT series_id, day_idx // 7 AS w, (sum(f) + coalesce(max(f) FILTER (day_idx = n_days - 1) * CASE WHEN any_value(n_days) % 7 = 0 THEN 0 ELSE 7 - any_value(n_days) % 7 END, 0)) / 7 AS m, any_value(n_days) AS t FROM panel GROUP BY ALL),
e AS (SELECT quantile_cont(m, 0.2) AS e0, quantile_cont(m, 0.4666666666666667) AS e1, quantile_cont(m, 0.7333333333333333) AS e2, quantile_cont(m, 1.0) AS e3 FROM wk WHERE m > 0),
s AS (SELECT series_id, w, t, (e0 <= m)::INT + (e1 <= m)::INT + (e2 <= m)::INT + (e3 <= m)::INT AS s FROM wk, e),
l AS (SELECT *, lead(s, 1) OVER o AS a, lead(s, 2) OVER o AS b, w - row_number() OVER (PARTITION BY series_id, s ORDER BY w) AS isl FROM s WINDOW o AS (PARTITION BY series_id ORDER BY w)),
ru AS (SELECT series_id, s, isl, count(*) AS len FROM l GROUP BY ALL), rd AS (SELECT series_id, max(len) AS mx, """ + ", ".join(f"least(coalesce(avg(len) FILTER (s = {k}), 0), 10) AS duration_{k}" for k in range(5)) + """ FROM ru GROUP BY 1),
g AS (SELECT series_id, count(*) AS n, any_value(t) AS t, count(*) FILTER (s <> a) AS tr, count(DISTINCT (s, a, b)) FILTER (b IS NOT NULL) AS tri, """ + ", ".join(f"avg((s = {k})::INT) AS freq_{k}" for k in range(5)) + " FROM l GROUP BY 1)",
    "g JOIN rd USING (series_id)", "series_id", [("tr / (n - 1)::DOUBLE", "transition_rate"), ("greatest(" + ", ".join(f"freq_{k}" for k in range(5)) + ")", "mode_share"),
                                                 (" + ".join(f"CASE WHEN freq_{k} > 0 THEN -freq_{k} * ln(freq_{k}) ELSE 0 END" for k in range(5)), "entropy"), ("mx / n::DOUBLE", "longest_share")]
    + [f"freq_{k}" for k in range(5)] + [f"duration_{k}" for k in range(5)] + [("tri / least(n * n, t)::DOUBLE", "trigram_diversity")]))
def _(spark, sf):
    return rounded(X.symbol_features(T.filled(spark, sf)))


# ---------------------------------------------------------------- F


@query("run_lengths", "F-1", "WITH " + PANEL + ",\n" + runs_sql("panel", "is_missing", "r") + " SELECT series_id, start, length FROM r")
def _(spark, sf):
    return RU.runs(T.panel(spark, sf), F.col("is_missing")).drop("run")


@query("run_summary", "F-1", sel(PANEL + ",\n" + runs_sql("panel", "value >= 40", "r"), "(SELECT DISTINCT series_id FROM panel) LEFT JOIN r USING (series_id) GROUP BY 1",
                                 "series_id, count(length) AS run_count, coalesce(max(length), 0) AS run_longest", [("coalesce(avg(length), 0)", "run_mean")]))
def _(spark, sf):
    return rounded(RU.run_stats(T.panel(spark, sf), F.col("value") >= 40))


@query("gap_length_buckets", "F-2", sel(PANEL + ",\n" + runs_sql("panel", "is_missing", "r") + """,
b AS (SELECT CASE WHEN length <= 5 THEN 'short' WHEN length <= 60 THEN 'medium' WHEN length <= 200 THEN 'long' ELSE 'extreme' END AS bucket, count(*) AS n FROM r GROUP BY 1)""", "b", "bucket, n", [("n / sum(n) OVER ()", "share")]))
def _(spark, sf):
    return rounded(RU.run_length_buckets(T.panel(spark, sf), F.col("is_missing")))


def cusum_sql(src: str, v: str, valid: str, reject: bool, post: str) -> str:
    """Recursive-free check through a different route: the reflected walk as running sum minus running minimum in SQL."""
    strong = "CASE WHEN down THEN ratio <= 0.95 ELSE ratio >= 1.05 END" if reject else "true"
    pers = "down" if reject else "true"
    return f"""ok AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day_idx) - 1 AS p, count(*) OVER (PARTITION BY series_id) AS nv FROM {src} WHERE {valid}),
rf AS (SELECT series_id, avg({v}) AS mu, stddev_pop({v}) + 1e-6 AS sd FROM ok WHERE p < least(nv // 2, 200) GROUP BY 1),
wk AS (SELECT ok.*, mu, sd, sum({v} - mu - 0.2 * sd) OVER w AS cp_, sum(mu - 0.2 * sd - {v}) OVER w AS cn_ FROM ok JOIN rf USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY day_idx)),
rw AS (SELECT *, cp_ - least(0, min(cp_) OVER w) AS sp, cn_ - least(0, min(cn_) OVER w) AS sn FROM wk WINDOW w AS (PARTITION BY series_id ORDER BY day_idx)),
al AS (SELECT series_id, any_value(nv) AS nv, min(day_idx) FILTER (sp > 3 * sd) AS rise, min(day_idx) FILTER (sn > 3 * sd) AS fall FROM rw GROUP BY 1),
a2 AS (SELECT *, least(rise, fall) AS cp, fall IS NOT NULL AND (rise IS NULL OR fall <= rise) AS down FROM al),
mm AS (SELECT s.series_id, any_value(nv) AS nv, any_value(cp) AS cp, any_value(down) AS down, any_value(n_days) AS nd, avg({post}) FILTER (day_idx < cp) AS pre, avg({post}) FILTER (day_idx >= cp) AS post FROM {src} s LEFT JOIN a2 USING (series_id) GROUP BY 1),
m2 AS (SELECT *, post / (pre + 1e-6) AS ratio FROM mm), m3 AS (SELECT *, coalesce(nv >= 60 AND cp >= 30 AND cp <= nd - 30 AND {strong}, false) AS hit FROM m2),
ps AS (SELECT series_id, avg(coalesce({post} < m3.post * 1.5, false)::INT) AS ps FROM {src} JOIN m3 USING (series_id) WHERE hit AND day_idx >= cp GROUP BY 1),
cus AS (SELECT m3.series_id, hit::INT AS has_cp, CASE WHEN hit THEN cp ELSE -1 END AS cp, CASE WHEN hit THEN pre ELSE 0 END AS pre_mean, CASE WHEN hit THEN post ELSE 0 END AS post_mean, CASE WHEN hit THEN ratio ELSE 1 END AS change_ratio, CASE WHEN hit AND {pers} THEN ps ELSE 0 END AS persistence
  FROM m3 LEFT JOIN ps USING (series_id))"""


@query("cusum_changepoint", "F-3", sel(PANEL + ",\n" + cusum_sql("panel", "value", "value IS NOT NULL", True, "value"), "cus", "series_id, has_cp, CAST(cp AS INTEGER) AS cp", "pre_mean, post_mean, change_ratio, persistence"))
def _(spark, sf):
    return rounded(RU.cusum_shift(T.panel(spark, sf), "value", F.col("value").isNotNull()))


@query("cusum_positive", "F-4", sel(PANEL + ",\n" + cusum_sql("panel", "f", "f > 0", False, "f"), "cus", "series_id, has_cp, CAST(cp AS INTEGER) AS cp", "pre_mean, post_mean, change_ratio, persistence"))
def _(spark, sf):
    return rounded(RU.cusum_shift(T.filled(spark, sf), "f", F.col("f") > 0, reject_weak=False))


@query("cumulative_deviation", "F-5", sel(PANEL + """,
c AS (SELECT *, sum(f - mu) OVER (PARTITION BY series_id ORDER BY day_idx) AS cs FROM (SELECT *, avg(f) OVER (PARTITION BY series_id) AS mu FROM panel))""", "c GROUP BY 1",
                                          "series_id, arg_min(day_idx, struct_pack(a := -round(abs(cs), 6), b := day_idx)) AS peak_day", [("max(cs)", "cusum_max"), ("min(cs)", "cusum_min"), ("max(cs) - min(cs)", "cusum_range")], 4))
def _(spark, sf):
    return rounded(RU.cumulative_deviation(T.filled(spark, sf), "f"), 4)


@query("slope_break", "C-35, F-4", sel(PANEL + ",\n" + cusum_sql("panel", "f", "f > 0", False, "f") + """,
sb AS (SELECT series_id, any_value(has_cp) AS has_cp, stddev_pop(f) FILTER (day_idx >= cp) / (stddev_pop(f) FILTER (day_idx < cp) + 1e-6) AS vr, regr_slope(f, day_idx) FILTER (day_idx >= cp) - regr_slope(f, day_idx) FILTER (day_idx < cp) AS sl FROM panel JOIN cus USING (series_id) GROUP BY 1)""",
                                       "sb", "series_id, has_cp", [("CASE WHEN has_cp = 1 THEN vr ELSE 1 END", "var_ratio"), ("CASE WHEN has_cp = 1 THEN sl ELSE 0 END", "slope_break")]))
def _(spark, sf):
    from ..operators.profiles import slope_break
    f = T.filled(spark, sf)
    return rounded(slope_break(f, RU.cusum_shift(f, "f", F.col("f") > 0, reject_weak=False)))


EMD = PANEL + ",\n" + ",\n".join(ma_sql("panel" if i == 0 else f"em{i - 1}", "f" if i == 0 else f"s{i - 1}", w, f"s{i}", f"em{i}") for i, w in enumerate((7, 15, 31, 63))) + """,
emd AS (SELECT series_id, f - s0 AS c0, s0 - s1 AS c1, s1 - s2 AS c2, s2 - s3 AS c3, s3 AS c4 FROM em3),
ee AS (SELECT series_id, """ + ", ".join(f"avg(c{i}) AS c{i}_mean, stddev_pop(c{i}) AS c{i}_std, sum(c{i} * c{i}) AS e{i}" for i in range(5)) + """ FROM emd GROUP BY 1),
et AS (SELECT *, e0 + e1 + e2 + e3 + e4 + 1e-12 AS tot FROM ee)"""


@query("component_fuzzy_entropy", "E-11, F-6", sel(EMD.split(",\nee AS")[0].replace("emd AS (SELECT series_id,", "emd AS (SELECT series_id, day_idx, n_days,") + """,
cl AS (""" + " UNION ALL ".join(f"SELECT series_id, 'c{i}' AS component, day_idx AS i, c{i} AS v FROM emd" for i in range(5)) + """),
cm AS (SELECT *, v - avg(v) OVER s AS x, pow(0.15 * stddev_pop(v) OVER s + 1e-12, 2) AS r2, count(*) OVER s AS n FROM cl WINDOW s AS (PARTITION BY series_id, component)),
cv AS (SELECT *, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM cm WINDOW w AS (PARTITION BY series_id, component ORDER BY i)),
cp AS (SELECT a.series_id, a.component, any_value(a.n) AS n, sum(exp(-(pow(a.x - b.x, 2) + pow(a.x1 - b.x1, 2)) / a.r2)) AS s2, sum(exp(-(pow(a.x - b.x, 2) + pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2)) / a.r2)) AS s3
  FROM cv a JOIN cv b ON a.series_id = b.series_id AND a.component = b.component AND a.i < b.i GROUP BY 1, 2)""", "cp", "series_id, component",
    [("ln(greatest(2 * s2 / ((n - 1) * (n - 2)), 1e-12)) - ln(greatest(2 * s3 / ((n - 2) * (n - 3)), 1e-12))", "fuzzy_entropy")], 4))
def _(spark, sf):
    return rounded(G.component_fuzzy_entropy(T.filled(spark, sf)), 4)


@query("smoothing_components", "F-6", sel(EMD, "et", "series_id", [x for i in range(5) for x in (f"c{i}_mean", f"c{i}_std", (f"ln(1 + e{i})", f"c{i}_energy_log"), (f"e{i} / tot", f"c{i}_rel_energy"))]
                                          + [("ln(1 + tot)", "total_energy_log"), ("sqrt((" + " + ".join(f"(e{i} / tot) ** 2" for i in range(5)) + ") / 5 - ((e0 + e1 + e2 + e3 + e4) / tot / 5) ** 2)", "rel_energy_std")], 5))
def _(spark, sf):
    return rounded(G.component_stats(T.filled(spark, sf)), 5)


def _cascade() -> str:
    out, cur, src = [], "f", "panel"
    for lv in range(5):
        w = 7 * 2 ** lv
        left, right, ce = w // 2, w - w // 2 - 1, (w + 1) // 2
        out.append(f"""k{lv}a AS (SELECT *, avg({cur}) OVER (PARTITION BY series_id ORDER BY day_idx ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING) AS ma FROM {src}),
k{lv}e AS (SELECT series_id, max(ma) FILTER (day_idx = {w // 2}) AS ea, max(ma) FILTER (day_idx = n_days - {ce} - 1) AS eb FROM k{lv}a GROUP BY 1),
k{lv} AS MATERIALIZED (SELECT k{lv}a.* EXCLUDE (ma), CASE WHEN day_idx < {w // 2} THEN ea WHEN day_idx > n_days - {ce} - 1 THEN eb ELSE ma END AS s{lv} FROM k{lv}a JOIN k{lv}e USING (series_id))""")
        cur, src = f"s{lv}", f"k{lv}"
    return PANEL + ",\n" + ",\n".join(out)


@query("cascade_levels", "F-7", sel(_cascade(), "k4 GROUP BY 1", "series_id", [x for lv in range(5) for x in (
    (f"avg(abs({'f' if lv == 0 else f's{lv - 1}'} - s{lv}))", f"level{lv}_abs_mean"), (f"stddev_pop({'f' if lv == 0 else f's{lv - 1}'} - s{lv})", f"level{lv}_std"),
    (f"sum(({'f' if lv == 0 else f's{lv - 1}'} - s{lv}) ** 2) / (sum(f * f) + 1e-10)", f"level{lv}_energy"))], 5))
def _(spark, sf):
    return rounded(G.cascade_stats(T.filled(spark, sf)), 5)


# ---------------------------------------------------------------- G


def _bin(p: int) -> str:
    return f"least(round_even(n_days / {p}.0, 0), n_days - 1)"


@query("period_power", "G-1, G-2", sel(PANEL + """,
c AS (SELECT *, f - avg(f) OVER (PARTITION BY series_id) AS c FROM panel),
d AS (SELECT series_id, (any_value(n_days) * sum(c * c) - CASE WHEN any_value(n_days) % 2 = 0 THEN sum(c * CASE WHEN day_idx % 2 = 0 THEN 1 ELSE -1 END) ** 2 ELSE 0 END) / 2 + 1e-8 AS tot, """ + ", ".join(
    f"sum(c * cos(2 * pi() * {_bin(p)} * day_idx / n_days)) ** 2 + sum(c * sin(2 * pi() * {_bin(p)} * day_idx / n_days)) ** 2 AS p{p}" for p in (7, 30, 90, 180)) + " FROM c GROUP BY 1)",
    "d", "series_id", [(f"p{p} / tot", f"power_{n}") for n, p in G.PERIODS.items()]))
def _(spark, sf):
    return rounded(G.period_power(T.filled(spark, sf)))


SPEC = WEEKS + """,
ws AS (SELECT series_id, week, week_mean - avg(week_mean) OVER (PARTITION BY series_id) AS x, count(*) OVER (PARTITION BY series_id) AS n FROM weeks),
spec AS MATERIALIZED (SELECT series_id, CAST(k AS INTEGER) AS k, any_value(n) AS n, k / any_value(n)::DOUBLE AS freq, sum(x * cos(2 * pi() * k * week / n)) ** 2 + sum(x * sin(2 * pi() * k * week / n)) ** 2 AS power
  FROM ws, range(400) t(k) WHERE k <= n // 2 GROUP BY series_id, k)"""


def weekly_arrays(spark, sf):
    return P.series_arrays(C.weekly(T.filled(spark, sf)), "week_mean", "week")


@query("periodogram", "G-1", sel(SPEC, "spec", "series_id, k", [("ln(1 + power)", "log_power")], 5))
def _(spark, sf):
    return rounded(G.spectrum(weekly_arrays(spark, sf)).select("series_id", "k", F.log1p("power").alias("log_power")), 5)


@query("spectral_summary", "G-2, C-19", sel(SPEC + """,
s AS (SELECT *, sum(power) OVER (PARTITION BY series_id) + 1e-8 AS t FROM spec WHERE k > 0 AND freq < 0.5),
g AS (SELECT series_id, sum(-power / t * ln(power / t + 1e-8)) AS spectral_entropy, arg_max(freq, power) AS dominant_freq, coalesce(sum(power) FILTER (freq < 0.01), 0) / (coalesce(sum(power) FILTER (freq >= 0.01), 0) + 1e-8) AS low_high_ratio FROM s GROUP BY 1)""",
                                            "g", "series_id", ["spectral_entropy", "dominant_freq", "low_high_ratio", ("1 / (dominant_freq + 1e-8)", "dominant_period"), ("1 / (spectral_entropy + 1e-8)", "too_regular")], 5))
def _(spark, sf):
    return rounded(G.spectral_summary(G.spectrum(weekly_arrays(spark, sf))), 5)


@query("fft_block", "G-3", sel(SPEC + """,
s AS (SELECT *, sum(power) OVER w + 1e-12 AS t, max(k) OVER w AS kx FROM spec WINDOW w AS (PARTITION BY series_id)),
p AS (SELECT *, power / t AS p, sum(power / t) OVER (PARTITION BY series_id ORDER BY k) AS cum, least(k * 8 // kx, 7) AS b FROM s),
g AS (SELECT series_id, ln(1 + any_value(t)) AS total_energy, sum(-p * ln(p + 1e-12)) AS spectral_entropy, arg_max(freq, power) AS dominant_freq, max(p) AS dominant_power_ratio, any_value(n) AS n,
  coalesce(sum(power) FILTER (freq < 0.01), 0) / (coalesce(sum(power) FILTER (freq >= 0.01), 0) + 1e-12) AS low_high_ratio, sum(freq * p) AS centroid, coalesce(min(freq) FILTER (cum >= 0.8), max(freq)) AS rolloff_80,
  exp(avg(ln(p + 1e-12))) / (avg(p) + 1e-12) AS flatness, """ + ", ".join(f"coalesce(sum(p) FILTER (b = {b}), 0) AS band_{b}" for b in range(8)) + """ FROM p GROUP BY 1),
bb AS (SELECT series_id, stddev_pop(x) AS band_std, max(x) AS band_max, min(x) AS band_min FROM (SELECT series_id, unnest([""" + ", ".join(f"band_{b}" for b in range(8)) + "]) AS x FROM g) GROUP BY 1)",
    "g JOIN bb USING (series_id)", "series_id", ["total_energy", "spectral_entropy", "dominant_freq", "dominant_power_ratio", ("CASE WHEN dominant_freq > 1e-6 THEN 1 / dominant_freq ELSE n END", "dominant_period"), "low_high_ratio", "centroid", "rolloff_80", "flatness"]
    + [f"band_{b}" for b in range(8)] + ["band_std", "band_max", "band_min"], 5))
def _(spark, sf):
    return rounded(G.fft_block(G.spectrum(weekly_arrays(spark, sf))), 5)


_EDGES = "[" + ", ".join(f"0.001 * 500.0 ** ({i} / 10.0)" for i in range(11)) + "]"


@query("log_band_features", "G-4", sel(SPEC + f""",
s AS (SELECT *, sum(power) OVER (PARTITION BY series_id) + 1e-10 AS t, sqrt(power) AS a, len(list_filter({_EDGES}, lambda e: e <= freq)) - 1 AS band FROM spec),
c AS (SELECT *, sum(freq * a) OVER w / (sum(a) OVER w + 1e-10) AS c FROM s WHERE band >= 0 AND band < 10 WINDOW w AS (PARTITION BY series_id, band))""", "c GROUP BY ALL HAVING count(*) >= 2", "series_id, CAST(band AS INTEGER) AS band",
                                       [("sum(power) / any_value(t)", "energy"), ("any_value(c)", "centroid"), ("sqrt(sum((freq - c) ** 2 * a) / (sum(a) + 1e-10))", "spread")], 5))
def _(spark, sf):
    return rounded(G.log_bands(G.spectrum(weekly_arrays(spark, sf))), 5)


@query("leading_magnitudes", "G-5", sel(SPEC + ", mu AS (SELECT series_id, abs(sum(week_mean)) AS dc FROM weeks GROUP BY 1)", "spec JOIN mu USING (series_id) WHERE k < 64", "series_id, k", [("CASE WHEN k = 0 THEN dc ELSE sqrt(power) END", "magnitude")], 4))
def _(spark, sf):
    m = G.leading_magnitudes(weekly_arrays(spark, sf))
    return rounded(m.select("series_id", F.posexplode("magnitude").alias("k", "magnitude")), 4)


@query("spectral_shares", "C-23, C-31", sel(SPEC + """,
s AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS kk FROM spec),
r AS (SELECT series_id, sum(power) FILTER (k < greatest(2, kk // 10)) / (sum(power) + 1e-12) AS fft_low, sum(power) FILTER (k >= kk // 2) / (sum(power) + 1e-12) AS fft_high, exp(avg(ln(sqrt(power) + 1e-10)) FILTER (k > 0)) / (avg(sqrt(power)) FILTER (k > 0) + 1e-10) AS spectral_flatness FROM s GROUP BY 1)""",
                                            "r", "series_id", "fft_low, fft_high, spectral_flatness", 5))
def _(spark, sf):
    s = G.spectrum(weekly_arrays(spark, sf))
    return rounded(G.risk_spectrum(s).join(G.magnitude_flatness(s), "series_id"), 5)
