"""Sources, densification, cleaning and resampling (inventory A and B)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.numeric import rounded
from ..operators import clean as C
from ..operators.folds import series_folds
from ..session import cut_lineage
from ..sources import pool as SP, sinks, tables as T, wide
from .catalog import query
from .sqlbase import FOLDS, PANEL, READINGS, SCORES, rnd, sel

# ---------------------------------------------------------------- sources


def monthly_wide(spark, sf):
    """One row per series, one column per month named M/D/YYYY (columns bounded by the calendar)."""
    r = T.readings(spark, sf).withColumn("m", F.trunc("dt", "month"))
    lo, hi = r.agg(F.min("m"), F.max("m")).first()
    months = [(lo.year + (lo.month - 1 + k) // 12, (lo.month - 1 + k) % 12 + 1)
              for k in range((hi.year - lo.year) * 12 + hi.month - lo.month + 1)]
    names = [f"{m}/1/{y}" for y, m in months]
    w = (r.withColumn("h", F.date_format("m", "M/d/yyyy")).groupBy("series_id").pivot("h", names)
         .agg(F.sum("value")))
    y = (F.col("series_id") % 10 == 0).cast("int")
    return w.select(F.col("series_id").cast("string").alias("CONS_NO"), y.alias("FLAG"),
                    *[F.col(f"`{n}`") for n in names])


_MONTHLY = READINGS + """,
mon AS (SELECT series_id, CAST(date_trunc('month', dt) AS DATE) AS dt, sum(value) AS value FROM readings GROUP BY ALL),
msp AS (SELECT min(dt) AS lo, max(dt) AS hi FROM mon),
mcal AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS dt
         FROM msp),
mgrid AS (SELECT CAST(i.series_id AS VARCHAR) AS series_id, CAST(i.series_id % 10 = 0 AS INTEGER) AS label, c.dt, m.value
          FROM (SELECT DISTINCT series_id FROM readings) i CROSS JOIN mcal c
          LEFT JOIN mon m ON m.series_id = i.series_id AND m.dt = c.dt)"""


@query("wide_meter_csv", "A-1", sel(_MONTHLY, "mgrid GROUP BY ALL", "series_id, label",
                                    [("count(value)", "n_read"), ("coalesce(sum(value), 0)", "total")]))
def _(spark, sf):
    root = sinks.scratch(spark, "wide-csv")
    monthly_wide(spark, sf).write.mode("overwrite").csv(root, header=True)
    long = wide.unpivot_meters(wide.read_wide_csv(spark, root))
    return rounded(long.groupBy("series_id", "label").agg(
        F.count("value").cast("double").alias("n_read"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total")))


@query("wide_to_long", "A-2", sel(_MONTHLY, "mgrid", "series_id, label, dt", "value"))
def _(spark, sf):
    return rounded(wide.unpivot_meters(monthly_wide(spark, sf)))


@query("date_headers", "A-3", f"""WITH h AS (
  SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN strftime(l_shipdate, '%Y-%m') ELSE
    month(l_shipdate) || '/' || day(l_shipdate) || '/' || year(l_shipdate) END AS header,
    l_linenumber = 7 AS bad, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT DISTINCT header, CASE WHEN bad THEN 2000 ELSE CAST(year(d) AS INTEGER) END AS year,
  CASE WHEN bad THEN 1 ELSE CAST(month(d) AS INTEGER) END AS month, CASE WHEN bad THEN 1 ELSE CAST(day(d) AS INTEGER) END AS day,
  CASE WHEN bad THEN 6 ELSE CAST(month(d) AS INTEGER) END AS season,
  CASE WHEN bad THEN 0 ELSE CAST(isodow(d) - 1 AS INTEGER) END AS weekday FROM h""")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem")
    head = F.when(F.col("l_linenumber") == 7, F.date_format("l_shipdate", "yyyy-MM")) \
        .otherwise(F.date_format("l_shipdate", "M/d/yyyy"))
    return D.parse_headers(li.select(head.alias("header")).distinct(), "header")


@query("building_csv", "A-4", """SELECT event_type AS building, CAST(user_id % 3 <> 0 AS INTEGER) AS label,
  CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) + 0.0 AS load FROM events WHERE event_type <> 'view' GROUP BY ALL""")
def _(spark, sf):
    ev = T.events(spark, sf)
    kind = F.when(F.col("user_id") % 3 == 0, "Normal").otherwise(F.concat(F.lit("Theft"), F.col("user_id") % 3))
    cls = F.when(F.col("event_type") == "view", "0").otherwise(F.col("event_type"))
    root = sinks.scratch(spark, "building-csv")
    ev.select(F.col("value").alias("load"), cls.alias("Class"), kind.alias("theft")).write.mode("overwrite") \
        .csv(root, header=True)
    b = wide.read_building_csv(spark, root, ["load"])
    return rounded(b.groupBy("building", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("load")), 4)


_POOL = SCORES + ", pool AS (SELECT id, y, model, p FROM scores WHERE p BETWEEN 0.07 AND 0.93)"


def _pool(spark, sf):
    """Scores outside [0.07, 0.93] count as invalid, so several models lack some ids."""
    return T.scores(spark, sf).where("p between 0.07 and 0.93")


@query("pool_complete_models", "A-5", _POOL.join(["WITH ", """,
n AS (SELECT count(DISTINCT id) AS n FROM scores)
SELECT 'Clean-' || model AS model, CAST(count(*) AS BIGINT) AS n_ids, """]) + rnd("avg(p)") + """ AS mean_p FROM pool, n
WHERE model IN (""" + ", ".join(f"'m{i}'" for i in range(48)) + """) GROUP BY model, n.n HAVING count(DISTINCT id) = n.n""")
def _(spark, sf):
    ids = T.embeddings(spark, sf).select(F.col("vec_id").alias("id"))
    got = SP.read_pool(_pool(spark, sf), ids, allowed=[f"m{i}" for i in range(48)], prefix="Clean-")
    return rounded(got.groupBy("model").agg(F.count(F.lit(1)).alias("n_ids"), F.avg("p").alias("mean_p")))


@query("pool_discovery", "A-6", "WITH " + SCORES + """,
raw AS (SELECT id, CASE WHEN k < 40 THEN 'oof_m' || k WHEN k < 44 THEN 'aux_m' || k WHEN k = 44 THEN 'prior'
   ELSE 'OOF-x' || k END AS key, CASE WHEN k % 9 = 3 THEN 40 * p ELSE p END AS p FROM scores WHERE NOT (k > 50 AND p > 0.9)),
n AS (SELECT count(*) AS n FROM embeddings)
SELECT key, CAST(count(*) AS BIGINT) AS n_ids, """ + rnd("min(p)") + " AS lo, " + rnd("max(p)") + """ AS hi FROM raw, n
WHERE contains(lower(key), 'oof') OR key IN ('prior')
GROUP BY key, n.n HAVING count(*) = n.n AND max(p) <= 10 AND min(p) >= -10""")
def _(spark, sf):
    s = T.score_matrix(spark, sf).select("id", F.posexplode("p").alias("k", "p")).where("not (k > 50 and p > 0.9)")
    k = F.col("k")
    key = F.when(k < 40, F.concat(F.lit("oof_m"), k)).when(k < 44, F.concat(F.lit("aux_m"), k)) \
        .when(k == 44, "prior").otherwise(F.concat(F.lit("OOF-x"), k))
    raw = s.select("id", key.alias("key"), F.when(k % 9 == 3, 40 * F.col("p")).otherwise(F.col("p")).alias("p"))
    n = T.embeddings(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()
    found = SP.discover(raw, n)
    return rounded(found.select("key", "n_ids", "lo", "hi"))


@query("pool_include", "A-7", "WITH " + SCORES + "SELECT model, CAST(count(*) AS BIGINT) AS n FROM scores "
       "WHERE contains(model, 'm1') OR contains(model, '6') GROUP BY 1".replace("SELECT", " SELECT", 1))
def _(spark, sf):
    return SP.include(T.scores(spark, sf), ["m1", "6"]).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("label_version_fallback", "A-8", """WITH o AS (SELECT doc_id AS id, quality AS original,
  CASE WHEN toxic = 1 THEN 0 END AS cleaned, CASE WHEN doc_id % 2 = 0 AND toxic = 0 THEN quality END AS v3 FROM labels)
SELECT id, CAST(coalesce(v3, cleaned, original) AS INTEGER) AS label,
  CASE WHEN v3 IS NOT NULL THEN 'cleaned_v3' WHEN cleaned IS NOT NULL THEN 'cleaned' ELSE 'original' END AS source FROM o""")
def _(spark, sf):
    lab = T.table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    v = [lab.select("id", F.lit("original").alias("version"), F.col("quality").alias("label")),
         lab.where("toxic = 1").select("id", F.lit("cleaned").alias("version"), F.lit(0).alias("label")),
         lab.where("id % 2 = 0 and toxic = 0").select("id", F.lit("cleaned_v3").alias("version"),
                                                      F.col("quality").alias("label"))]
    versions = v[0].unionByName(v[1]).unionByName(v[2])
    return SP.choose_labels(versions, ["cleaned_v3", "cleaned", "original"])


@query("label_version_diff", "A-8", """SELECT CAST(quality AS INTEGER) AS original, CAST(1 - toxic AS INTEGER) AS alternate,
  CAST(count(*) AS BIGINT) AS n FROM labels WHERE quality <> 1 - toxic GROUP BY ALL""")
def _(spark, sf):
    v = T.label_versions(spark, sf)
    return SP.version_diff(v, "original", "alternate")


@query("stage_store", "A-9", "WITH " + SCORES + " SELECT model, CAST(count(*) AS BIGINT) AS n, "
       + rnd("sum(p)") + " AS total FROM scores GROUP BY 1")
def _(spark, sf):
    store = sinks.StageStore(spark, sinks.scratch(spark, "stages"))
    for _ in range(2):  # the second call reads what the first one wrote
        df = store.cache_or_compute("scores", lambda: T.scores(spark, sf).select("id", "model", "p"), ["model"])
    return rounded(df.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")))


@query("report_csv", "A-10", "WITH " + SCORES + " SELECT model, CAST(count(*) AS BIGINT) AS n, "
       + rnd("avg(p)", 4) + " AS mean_p FROM scores GROUP BY 1")
def _(spark, sf):
    rep = rounded(T.scores(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p")), 4)
    path = sinks.write_report(rep, sinks.scratch(spark, "report"), "mean_p")
    return spark.read.csv(path, header=True, schema="model string, n bigint, mean_p double")


# ---------------------------------------------------------------- panel


@query("panel_densify", "B-1", "WITH " + PANEL + " SELECT series_id, day_idx, dt, value, is_missing FROM panel")
def _(spark, sf):
    return T.panel(spark, sf).drop("n_days")


@query("panel_sanitize", "B-2", "WITH " + PANEL + """, x AS (SELECT series_id, day_idx, CASE WHEN value >= 120
  THEN CAST('Infinity' AS DOUBLE) WHEN value < 8 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v FROM panel)
SELECT series_id, day_idx, CASE WHEN v IS NULL OR NOT isfinite(v) THEN 0 ELSE v END AS clean FROM x""")
def _(spark, sf):
    v = F.when(F.col("value") >= 120, F.lit(float("inf"))).when(F.col("value") < 8, F.lit(float("nan"))) \
        .otherwise(F.col("value"))
    return T.panel(spark, sf).select("series_id", "day_idx", C.sanitize(v).alias("clean"))


@query("fill_series_median", "B-3", "WITH " + PANEL + """,
m AS (SELECT series_id, quantile_cont(value, 0.5) AS med FROM panel GROUP BY 1)
SELECT series_id, day_idx, coalesce(value, med, 0) AS filled FROM panel JOIN m USING (series_id)""")
def _(spark, sf):
    return C.fill_with_series_median(T.panel(spark, sf)).select("series_id", "day_idx", "filled")


@query("impute_layers", "B-4", sel(PANEL + """,
nb AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN day_idx END IGNORE NULLS) OVER a AS bp,
         last_value(value IGNORE NULLS) OVER a AS bv,
         first_value(CASE WHEN value IS NOT NULL THEN day_idx END IGNORE NULLS) OVER b AS np,
         first_value(value IGNORE NULLS) OVER b AS nv,
         avg(value) OVER (PARTITION BY series_id, month(dt), isodow(dt)) AS l2
       FROM panel WINDOW a AS (PARTITION BY series_id ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY series_id ORDER BY day_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
sm AS (SELECT series_id, avg(value) AS m FROM panel GROUP BY 1),
tb AS (SELECT quantile_cont(m, [0.2, 0.4, 0.6, 0.8]) AS q FROM sm WHERE m > 0),
ti AS (SELECT series_id, CASE WHEN m <= 0 THEN 0 WHEN m <= q[1] THEN 1 WHEN m <= q[2] THEN 2 WHEN m <= q[3] THEN 3
         WHEN m <= q[4] THEN 4 ELSE 5 END AS tier FROM sm, tb),
pe AS (SELECT tier, day_idx, avg(value) AS peer FROM panel JOIN ti USING (series_id) WHERE value IS NOT NULL GROUP BY ALL),
l AS (SELECT nb.series_id, nb.day_idx, value, CASE WHEN value IS NOT NULL THEN value WHEN bp IS NOT NULL AND np IS NOT NULL
         AND np - bp - 1 <= 7 THEN bv + (nv - bv) * (nb.day_idx - bp) / (np - bp) END AS l1, l2, peer
      FROM nb JOIN ti USING (series_id) LEFT JOIN pe ON pe.tier = ti.tier AND pe.day_idx = nb.day_idx),
o AS (SELECT series_id, day_idx, CAST(CASE WHEN value IS NOT NULL THEN 0 WHEN l1 IS NOT NULL THEN 1 WHEN l2 IS NOT NULL THEN 2
         WHEN peer IS NOT NULL THEN 3 ELSE 4 END AS INTEGER) AS layer, coalesce(l1, l2, peer, 0) AS filled FROM l)""",
                                       "o", "series_id, day_idx, layer", "filled"))
def _(spark, sf):
    return rounded(C.impute_layers(T.panel(spark, sf, neighbours=True)).select("series_id", "day_idx", "layer", "filled"))


def weekly_readings(spark, sf):
    """Readings on a weekly grid (one 'day' per week), dense enough for the gated imputation."""
    r = T.readings(spark, sf)
    week = F.date_add(F.to_date(F.lit("1995-01-01")), F.floor(F.datediff("dt", F.to_date(F.lit("1995-01-01"))) / 7).cast("int"))
    return r.groupBy("series_id", week.alias("dt")).agg(F.sum("value").alias("value"))


def weekly_imputed(spark, sf):
    return C.impute_by_sparsity(weekly_readings(spark, sf))


WEEKLY = PANEL.replace("""SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS dt,""",
                       """SELECT l_suppkey AS series_id, CAST(DATE '1995-01-01' +
  CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7) AS INTEGER) AS DATE) AS dt,""")

_GATED = WEEKLY + """,
rate AS (SELECT day_idx, avg(CAST(is_missing AS INTEGER)) AS r, quantile_cont(value, 0.5) AS med FROM panel GROUP BY 1),
dp AS (SELECT *, r <= 0.3 AS dense, sum(CAST(r <= 0.3 AS INTEGER)) OVER (ORDER BY day_idx) - 1 AS dpos FROM rate),
dn AS (SELECT p.series_id, p.day_idx, d.dpos, p.value FROM panel p JOIN dp d USING (day_idx) WHERE dense),
nb AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN dpos END IGNORE NULLS) OVER a AS bp,
         last_value(value IGNORE NULLS) OVER a AS bv,
         first_value(CASE WHEN value IS NOT NULL THEN dpos END IGNORE NULLS) OVER b AS np,
         first_value(value IGNORE NULLS) OVER b AS nv
       FROM dn WINDOW a AS (PARTITION BY series_id ORDER BY dpos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY series_id ORDER BY dpos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
li AS (SELECT series_id, day_idx, CASE WHEN value IS NOT NULL THEN value WHEN bp IS NULL THEN nv WHEN np IS NULL THEN bv
         ELSE bv + (nv - bv) * (dpos - bp) / (np - bp) END AS v FROM nb),
gated AS (SELECT p.series_id, p.day_idx, d.dense, coalesce(CASE WHEN d.dense THEN li.v ELSE p.value END, d.med, 0) AS filled
          FROM panel p JOIN dp d USING (day_idx) LEFT JOIN li ON li.series_id = p.series_id AND li.day_idx = p.day_idx)"""


@query("impute_by_sparsity", "B-5", sel(_GATED, "gated", "series_id, day_idx, dense", "filled"))
def _(spark, sf):
    return rounded(weekly_imputed(spark, sf).select("series_id", "day_idx", "dense", "filled"))


@query("clip_day_mad", "B-6", sel(_GATED + """,
md AS (SELECT day_idx, quantile_cont(filled, 0.5) AS med FROM gated GROUP BY 1),
ma AS (SELECT day_idx, med, quantile_cont(abs(filled - med), 0.5) AS mad FROM gated JOIN md USING (day_idx) GROUP BY ALL),
cl AS (SELECT series_id, day_idx, CASE WHEN mad > 0 THEN least(greatest(filled, med - 5 * mad), med + 5 * mad) ELSE filled END
       AS clipped FROM gated JOIN ma USING (day_idx))""", "cl", "series_id, day_idx", "clipped"))
def _(spark, sf):
    # imputed values are read four times by the two quantile passes: materialize them once
    x = cut_lineage(weekly_imputed(spark, sf).select("series_id", "day_idx", "filled"))
    return rounded(C.clip_to_day_mad(x, "filled").select("series_id", "day_idx", "clipped"))


WINSOR = PANEL + """,
wq AS (SELECT quantile_cont(f, [0.01, 0.99]) AS q FROM panel),
wz AS (SELECT panel.*, least(greatest(f, q[1]), q[2]) AS winsorized FROM panel, wq),
wins AS MATERIALIZED (SELECT *, ln(1 + greatest(winsorized, 0)) AS transformed FROM wz)"""


@query("winsorize_log", "B-7", sel(WINSOR, "wins", "series_id, day_idx", "winsorized, transformed"))
def _(spark, sf):
    return rounded(C.winsorize_log(T.filled(spark, sf)).select("series_id", "day_idx", "winsorized", "transformed"))


@query("zscore_channels", "B-8", sel(PANEL + """,
d AS (SELECT *, f - lag(f) OVER (PARTITION BY series_id ORDER BY day_idx) AS d0 FROM panel),
e AS (SELECT *, coalesce(d0, lead(d0) OVER (PARTITION BY series_id ORDER BY day_idx), 0) AS df FROM d),
z AS (SELECT series_id, day_idx, (f - avg(f) OVER s) / (stddev_pop(f) OVER s + 1e-6) AS z_value,
  (df - avg(df) OVER s) / (stddev_pop(df) OVER s + 1e-6) AS z_diff FROM e WINDOW s AS (PARTITION BY series_id))""",
                                     "z", "series_id, day_idx", "z_value, z_diff", 5))
def _(spark, sf):
    return rounded(C.zscore_channels(T.filled(spark, sf)).select("series_id", "day_idx", "z_value", "z_diff"), 5)


@query("standardize_by_day", "B-9", sel(PANEL + """,
s AS (SELECT day_idx, avg(ln(1 + f)) AS mu, stddev_pop(ln(1 + f)) AS sd FROM panel GROUP BY 1),
z AS (SELECT series_id, day_idx, CAST(is_missing AS INTEGER) AS ch_missing, CAST(f = 0 AS INTEGER) AS ch_zero,
  least(greatest((ln(1 + f) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, -5), 5) AS scaled FROM panel JOIN s USING (day_idx))""",
                                        "z", "series_id, day_idx, ch_missing, ch_zero", "scaled"))
def _(spark, sf):
    return rounded(C.standardize_by_day(T.filled(spark, sf)).select("series_id", "day_idx", "ch_missing", "ch_zero", "scaled"))


@query("winsorize_by_fold", "B-10", sel(PANEL + ",\n" + FOLDS + """,
st AS (SELECT k AS fold, quantile_cont(f, [0.01, 0.99, 0.95, 0.99, 0.999]) AS q FROM panel JOIN folds USING (series_id)
       CROSS JOIN range(5) t(k) WHERE k <> fold GROUP BY 1),
o AS (SELECT series_id, day_idx, st.fold, q[3] AS p95, q[4] AS p99, q[5] AS p999, ln(1 + greatest(least(greatest(f, q[1]), q[2]), 0)) AS transformed
      FROM panel JOIN folds USING (series_id) JOIN st ON st.fold = folds.fold)""",
                                        "o", "series_id, day_idx, CAST(fold AS INTEGER) AS fold", "p95, p99, p999, transformed"))
def _(spark, sf):
    folds = series_folds(spark, sf).select("series_id", "fold")
    x = C.winsorize_by_fold(T.filled(spark, sf), folds, 5)
    return rounded(x.select("series_id", "day_idx", "fold", "p95", "p99", "p999", "transformed"))


@query("rolling_volatility", "B-11", sel(PANEL + """,
v AS (SELECT series_id, day_idx, avg(f) OVER w AS m, avg(f * f) OVER w AS m2 FROM panel
      WINDOW w AS (PARTITION BY series_id ORDER BY day_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""",
                                         "v", "series_id, day_idx", [("sqrt(greatest(m2 - m * m, 0))", "volatility")], 4))
def _(spark, sf):
    return rounded(T.filled(spark, sf).select("series_id", "day_idx", C.rolling_std("f").alias("volatility")), 4)


@query("window_entropy", "B-12", sel(PANEL + """,
nw AS (SELECT CAST(floor((n_days - 30) / 7) AS INTEGER) AS last FROM span),
h AS (SELECT series_id, w, (f >= 1)::INT + (f >= 10)::INT + (f >= 25)::INT + (f >= 50)::INT + (f >= 100)::INT AS lev, count(*) AS c
      FROM panel, nw, range(1000) t(w) WHERE w <= nw.last AND day_idx BETWEEN 7 * w AND 7 * w + 29 GROUP BY ALL),
e AS (SELECT series_id, w, sum(-c / 30.0 * ln(c / 30.0)) AS entropy FROM h GROUP BY ALL),
o AS (SELECT series_id, day_idx, coalesce(entropy, 0) AS entropy FROM (SELECT series_id, day_idx,
  greatest(least(CAST(floor((day_idx - 29) / 7.0) AS INTEGER), nw.last), 0) AS w FROM panel, nw) LEFT JOIN e USING (series_id, w))""",
                                     "o", "series_id, day_idx", "entropy"))
def _(spark, sf):
    return rounded(C.window_entropy(T.filled(spark, sf)).select("series_id", "day_idx", "entropy"))


def ma_sql(src: str, v: str, w: int, out: str, cte: str) -> str:
    """CTE `cte`: src plus the moving average of `v` whose outside slots repeat the end values."""
    left, right = w // 2, w - w // 2 - 1
    return f"""{cte} AS MATERIALIZED (SELECT *, (sum({v}) OVER (PARTITION BY series_id ORDER BY day_idx ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)
  + greatest({left} - day_idx, 0) * first_value({v}) OVER (PARTITION BY series_id ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  + greatest(day_idx + {right} - (n_days - 1), 0) * last_value({v}) OVER (PARTITION BY series_id ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  ) / {w}.0 AS {out} FROM {src})"""


STL = PANEL + ",\n" + ma_sql("panel", "f", 7, "trend", "tr") + """,
stl AS MATERIALIZED (SELECT *, avg(f - trend) OVER (PARTITION BY series_id, day_idx % 7) AS seasonal,
  f - trend - avg(f - trend) OVER (PARTITION BY series_id, day_idx % 7) AS residual FROM tr)"""


@query("seasonal_residual", "B-13", sel(STL, "stl", "series_id, day_idx", "trend, seasonal, residual", 5))
def _(spark, sf):
    x = C.seasonal_residual(T.filled(spark, sf))
    return rounded(x.select("series_id", "day_idx", "trend", "seasonal", "residual"), 5)


STL2 = PANEL + ",\n" + ma_sql("panel", "f", 7, "t7", "a7") + ", det AS (SELECT *, f - t7 AS det FROM a7),\n" \
    + ma_sql("det", "det", 90, "t90", "a90")


@query("two_scale_residual", "B-14", sel(STL2, "a90", "series_id, day_idx", [("det - t90", "residual2")], 5))
def _(spark, sf):
    return rounded(C.two_scale_residual(T.filled(spark, sf)).select("series_id", "day_idx", "residual2"), 5)


def _segs(*res: int) -> str:
    vals = ", ".join(f"({r})" for r in res)
    return PANEL + f""",
sb AS (SELECT res, i AS seg, round_even(i * n_days / res::DOUBLE, 0) AS s, round_even((i + 1) * n_days / res::DOUBLE, 0) AS e
       FROM span, (VALUES {vals}) r(res), range(200) t(i) WHERE i < res)"""


@query("paa_50", "B-15", sel(_segs(50) + """,
o AS (SELECT series_id, CAST(seg AS INTEGER) AS seg, coalesce(avg(value), 0) AS paa FROM panel JOIN sb ON day_idx >= s AND day_idx < e GROUP BY ALL)""",
                             "o", "series_id, seg", "paa"))
def _(spark, sf):
    return rounded(C.paa(T.panel(spark, sf), 50))


@query("paa_channels", "B-16", sel(_segs(25, 50, 100) + """,
o AS (SELECT series_id, res, seg, coalesce(avg(value), 0) AS v FROM panel JOIN sb ON day_idx >= s AND day_idx < e GROUP BY ALL),
z AS (SELECT series_id, res, seg, least(greatest((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), -5), 5) AS z FROM o WINDOW w AS (PARTITION BY series_id, res)),
g AS (SELECT series_id, CAST(res AS INTEGER) AS res, CAST(pos AS INTEGER) AS pos FROM (SELECT DISTINCT series_id, res FROM z), range(100) t(pos))""",
                                   "g LEFT JOIN z ON z.series_id = g.series_id AND z.res = g.res AND z.seg = g.pos",
                                   "g.series_id, g.res, g.pos", [("coalesce(z, 0)", "z")], 5))
def _(spark, sf):
    x = C.paa_channels(T.panel(spark, sf))
    return rounded(x.select("series_id", "res", F.posexplode("channel").alias("pos", "z")), 5)


@query("gap_channels", "B-17", sel(_segs(25, 50, 100) + """,
o AS (SELECT series_id, CAST(res AS INTEGER) AS res, CAST(seg AS INTEGER) AS seg, avg(is_missing::INT) AS miss_rate,
  avg((is_missing OR coalesce(value = 0, false))::INT) AS empty_rate FROM panel JOIN sb ON day_idx >= s AND day_idx < e GROUP BY ALL)""",
                                   "o", "series_id, res, seg", "miss_rate, empty_rate"))
def _(spark, sf):
    return rounded(C.gap_channels(T.panel(spark, sf)))


WEEKS = PANEL + """,
wk AS (SELECT series_id, CAST(day_idx // 7 AS INTEGER) AS week, avg(f) AS week_mean FROM panel WHERE day_idx < (n_days // 7) * 7 GROUP BY ALL),
weeks AS MATERIALIZED (SELECT *, (week_mean - avg(week_mean) OVER s) / (stddev_pop(week_mean) OVER s + 1e-6) AS week_z FROM wk
          WINDOW s AS (PARTITION BY series_id))"""


@query("weekly_profile", "B-18", sel(WEEKS, "weeks", "series_id, week", "week_mean, week_z", 5))
def _(spark, sf):
    return rounded(C.weekly(T.filled(spark, sf)), 5)


@query("adaptive_pool", "B-19", sel(PANEL + """,
o AS (SELECT series_id, CAST(i AS INTEGER) AS cell, avg(f) AS pooled FROM panel, range(96) t(i)
  WHERE day_idx >= (i * n_days) // 96 AND day_idx < ((i + 1) * n_days + 95) // 96 GROUP BY ALL)""", "o", "series_id, cell", "pooled"))
def _(spark, sf):
    return rounded(C.adaptive_pool(T.filled(spark, sf), 96))


CHANNELS = ["click", "error", "purchase", "signup", "view"]


def hourly(spark, sf):
    """user_id, hour and one column per event type: bounded by the hours of the calendar per user."""
    ev = T.events(spark, sf).groupBy("user_id", F.date_trunc("hour", "ts").alias("hour"))
    return ev.agg(*[F.coalesce(F.sum(F.when(F.col("event_type") == c, F.col("value"))), F.lit(0.0)).alias(c)
                    for c in CHANNELS])


_HOURLY = """hourly AS (SELECT user_id, date_trunc('hour', ts) AS hour, """ + ", ".join(
    f"coalesce(sum(value) FILTER (event_type = '{c}'), 0) AS \"{c}\"" for c in CHANNELS) + """ FROM events GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hour) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM hourly),
win AS (SELECT hr.*, CAST(w AS INTEGER) AS win, CAST(r - w * 8 AS INTEGER) AS pos FROM hr, range(5000) t(w)
  WHERE n >= 24 AND w <= (n - 24) // 8 AND r >= w * 8 AND r < w * 8 + 24)"""


@query("sliding_windows", "B-20", sel(_HOURLY, "win GROUP BY ALL", "user_id, win, CAST(count(*) AS BIGINT) AS n_rows",
                                      [(f'avg("{c}")', f'"{c}"') for c in CHANNELS]))
def _(spark, sf):
    x = C.sliding_rows(hourly(spark, sf), ["user_id"], "hour", 24, 8)
    return rounded(x.groupBy("user_id", "win").agg(F.count(F.lit(1)).alias("n_rows"),
                                                   *[F.avg(c).alias(c) for c in CHANNELS]))


@query("window_standardize", "B-21", sel(_HOURLY, "win", "user_id, win, pos, 1.0::DOUBLE AS mask", [
    (f'("{c}" - avg("{c}") OVER ()) / CASE WHEN stddev_pop("{c}") OVER () > 0 THEN stddev_pop("{c}") OVER () ELSE 1 END', f'"{c}"')
    for c in CHANNELS], 4))
def _(spark, sf):
    x = C.sliding_rows(hourly(spark, sf), ["user_id"], "hour", 24, 8)
    z = C.standardize_channels(x, CHANNELS)
    return rounded(z.select("user_id", "win", F.col("pos").cast("int").alias("pos"), "mask", *CHANNELS), 4)


@query("usage_covariates", "B-22", sel(PANEL, "panel GROUP BY 1", "series_id",
                                       [("ln(1 + max(value))", "log_max_usage"), ("avg(is_missing::INT)", "missing_rate")]))
def _(spark, sf):
    return rounded(C.usage_covariates(T.panel(spark, sf)))


@query("quantile_normal", "B-23")
def _(spark, sf):
    folds = series_folds(spark, sf).select("series_id", "fold")
    feats = T.readings(spark, sf).groupBy("series_id").agg(F.avg("value").alias("mean"), F.max("value").alias("max"),
                                                           F.count(F.lit(1)).cast("double").alias("n"))
    long = feats.unpivot("series_id", ["mean", "max", "n"], "feature", "value")
    return rounded(C.quantile_normal(long, folds, 5), 5)
