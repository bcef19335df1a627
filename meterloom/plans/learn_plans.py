"""Feature screening, folds, sampling and learners (inventory E-9, H, K-15, K-20)."""
from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import boosting as B, clean as C, extra_trees as X, isotonic as ISO, learn as L, metrics as M, pool as K, runs as RU, sampling as SA, select as SE, series_stats as S
from ..operators.folds import series_folds, series_labels, stratified_folds
from ..session import cut_lineage, gathered
from ..sources import tables as T
from .catalog import query
from .metric_plans import SERIES, auc_sql, series_scored, with_subgroup_of
from .peer_plans import vectors
from .series_plans import runs_sql
from .sqlbase import FOLDS, LABELS, PANEL, SCORES, sel

FEATS = ["mean", "std", "max", "missing_rate", "low_ratio", "log_max"]

# ---------------------------------------------------------------- screening and selection

SCREEN = ["mean", "std", "median", "mad", "q10", "q90", "slope", "missing_ratio", "gap_longest"]


@query("feature_screen", "E-9, C-1, C-2, C-8, C-9", sel(PANEL + ",\n" + LABELS + ",\n" + runs_sql("panel", "is_missing", "gp") + """,
md AS (SELECT series_id, quantile_cont(value, 0.5) AS med FROM panel GROUP BY 1),
x AS (SELECT panel.series_id, day_idx, is_missing, coalesce(value, med, 0) AS g FROM panel JOIN md USING (series_id)),
xm AS (SELECT series_id, quantile_cont(g, 0.5) AS m2 FROM x GROUP BY 1),
ft AS (SELECT series_id, avg(g) AS mean, stddev_pop(g) AS std, any_value(m2) AS median, avg(abs(g - m2)) AS mad, quantile_cont(g, 0.1) AS q10, quantile_cont(g, 0.9) AS q90, regr_slope(g, day_idx) AS slope, avg(is_missing::INT) AS missing_ratio FROM x JOIN xm USING (series_id) GROUP BY 1),
gl AS (SELECT series_id, max(length)::DOUBLE AS gap_longest FROM gp GROUP BY 1), fs AS (SELECT * FROM ft JOIN gl USING (series_id) JOIN series_labels USING (series_id)),
lo AS (""" + " UNION ALL ".join(f"SELECT y, '{c}' AS feature, round({c}, 9) AS p FROM fs" for c in SCREEN) + "),\n" + auc_sql("lo", "feature") + """,
mn AS (SELECT feature, avg(p) FILTER (y = 1) AS mean_pos, avg(p) FILTER (y = 0) AS mean_neg FROM lo GROUP BY 1)""", "auc JOIN mn USING (feature)", "feature, auc < 0.5 AS flipped", [("greatest(auc, 1 - auc)", "auc"), "mean_pos", "mean_neg"], 5))
def _(spark, sf):
    x = C.fill_with_series_median(T.panel(spark, sf)).withColumn("_m2", F.median("filled").over(S.whole()))
    ft = x.groupBy("series_id").agg(F.avg("filled").alias("mean"), F.stddev_pop("filled").alias("std"), F.first("_m2").alias("median"), F.avg(F.abs(F.col("filled") - F.col("_m2"))).alias("mad"),
                                    F.percentile("filled", [.1, .9]).alias("_q"), F.regr_slope("filled", "day_idx").alias("slope"), F.avg(F.col("is_missing").cast("double")).alias("missing_ratio"))
    gaps = RU.run_stats(x, F.col("is_missing"), prefix="gap").select("series_id", F.col("gap_longest").cast("double").alias("gap_longest"))
    ft = ft.select("*", F.col("_q")[0].alias("q10"), F.col("_q")[1].alias("q90")).join(gaps, "series_id").join(series_labels(spark, sf), "series_id")
    # one row per series from here on: materialized, the ranks read it several times
    long = cut_lineage(ft.select("series_id", "y", *[F.round(c, 9).alias(c) for c in SCREEN])).unpivot(["series_id", "y"], SCREEN, "feature", "value")
    return rounded(SE.screen(long), 5)


def series_long(spark, sf):
    return series_scored(spark, sf).withColumn("constant", F.lit(3.0)).unpivot(["series_id", "y"], FEATS + ["constant"], "feature", "value")


_LONG = SERIES + ",\nlo AS (" + " UNION ALL ".join(f"SELECT series_id, y, '{c}' AS feature, {c} AS value FROM ss" for c in FEATS) + " UNION ALL SELECT series_id, y, 'constant', 3.0 FROM ss)"


@query("varying_features", "H-1", sel(_LONG, "lo GROUP BY 1 HAVING stddev_samp(value) >= 1e-10", "feature", [("stddev_samp(value)", "std")]))
def _(spark, sf):
    return rounded(SE.varying(series_long(spark, sf)))


@query("feature_correlation", "H-2", sel(_LONG + ", ix AS (SELECT series_id, feature, value, list_position([" + ", ".join(f"'{c}'" for c in FEATS) + """], feature) - 1 AS k FROM lo WHERE feature <> 'constant')""",
                                         "ix a JOIN ix b ON a.series_id = b.series_id AND a.k < b.k GROUP BY ALL", "CAST(a.k AS INTEGER) AS a, CAST(b.k AS INTEGER) AS b", [("corr(a.value, b.value)", "corr")], 5))
def _(spark, sf):
    m = series_scored(spark, sf).select(F.array(*FEATS).alias("p"))
    return rounded(K.pearson_pairs(cut_lineage(m)), 5)


@query("drop_correlated", "H-2", "WITH RECURSIVE " + _LONG + f""", nm AS (SELECT unnest({FEATS}) AS feature, generate_subscripts({FEATS}, 1) AS k),
ix AS (SELECT series_id, k, value FROM lo JOIN nm USING (feature)), vr AS (SELECT k, var_pop(value) AS v FROM ix GROUP BY k),
pr AS (SELECT *, row_number() OVER (ORDER BY a, b) AS i FROM (SELECT a.k AS a, b.k AS b, corr(a.value, b.value) AS c FROM ix a JOIN ix b ON a.series_id = b.series_id AND a.k < b.k GROUP BY ALL)),
st AS (SELECT 0::BIGINT AS i, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT pr.i, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) OR abs(c) <= 0.9 THEN gone WHEN x.v < y.v THEN list_append(gone, a) ELSE list_append(gone, b) END
  FROM st JOIN pr ON pr.i = st.i + 1 JOIN vr x ON x.k = a JOIN vr y ON y.k = b)
SELECT feature FROM nm, (SELECT arg_max(gone, i) AS gone FROM st) WHERE NOT list_contains(gone, k)""")
def _(spark, sf):
    keep = SE.drop_correlated(series_scored(spark, sf).select(F.array(*FEATS).alias("p")), FEATS, 0.9)
    return spark.createDataFrame([(c,) for c in keep], "feature string")


@query("mutual_information", "H-3", sel(_LONG + """,
b AS (SELECT feature, y, (row_number() OVER (PARTITION BY feature ORDER BY value, series_id) - 1) * 10 // count(*) OVER (PARTITION BY feature) AS bin FROM lo WHERE feature <> 'constant'),
c AS (SELECT feature, bin, y, count(*) AS n FROM b GROUP BY ALL),
d AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM c)""", "d GROUP BY 1 ORDER BY round(sum(n / t * ln(n * t / (nb * ny))), 9) DESC, feature LIMIT 5", "feature", [("sum(n / t * ln(n * t / (nb * ny)))", "mi")]))
def _(spark, sf):
    mi = SE.mutual_information(series_long(spark, sf).where("feature <> 'constant'"))
    return rounded(mi.orderBy(F.round("mi", 9).desc(), "feature").limit(5))


# ---------------------------------------------------------------- folds, splits, weights


@query("stratified_folds", "H-4", "WITH " + FOLDS + " SELECT series_id, y, fold FROM folds")
def _(spark, sf):
    return series_folds(spark, sf)


@query("group_folds", "H-5", """WITH RECURSIVE g AS (SELECT user_id, count(*) AS n, ((user_id * 7919 + 42) % 10007) % 5 AS fold, sum(count(*)) OVER () AS t FROM events GROUP BY 1),
hv AS (SELECT user_id, n, row_number() OVER (ORDER BY n DESC, CAST(user_id AS VARCHAR)) AS i FROM g WHERE n * 50 > t),
pl AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST(NULL AS BIGINT) AS user_id, CAST(0 AS BIGINT) AS fold
  UNION ALL SELECT i, list_transform(range(5), lambda k: load[k + 1] + CASE WHEN k = p THEN n ELSE 0 END), user_id, p FROM (SELECT hv.i, hv.n, hv.user_id, load, CAST(list_position(load, list_min(load)) - 1 AS BIGINT) AS p FROM pl JOIN hv ON hv.i = pl.i + 1)),
al AS (SELECT g.user_id, g.n, coalesce(pl.fold, g.fold) AS fold FROM g LEFT JOIN pl ON pl.user_id = g.user_id)
SELECT CAST(fold AS INTEGER) AS fold, sum(n) AS n, count(*) AS groups FROM al GROUP BY 1""")
def _(spark, sf):
    f = SA.group_folds(T.events(spark, sf), "user_id", 5)
    return T.events(spark, sf).join(f, "user_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("groups"))


@query("time_split", "H-6", sel(PANEL, "panel GROUP BY ALL", "series_id, CASE WHEN day_idx < 800 THEN 'train' ELSE 'test' END AS part, count(*) AS n", [("avg(f)", "mean")]))
def _(spark, sf):
    x = T.filled(spark, sf).withColumn("part", F.when(F.col("day_idx") < 800, "train").otherwise("test"))
    return rounded(x.groupBy("series_id", "part").agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("mean")))


@query("leave_one_type_out", "H-7", "SELECT CAST(t.h AS INTEGER) AS held_out, CASE WHEN label = t.h THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM embeddings, (SELECT DISTINCT label AS h FROM embeddings) t GROUP BY ALL")
def _(spark, sf):
    e = T.embeddings(spark, sf)
    types = sorted(r.label for r in e.select("label").distinct().collect())  # as many as there are types
    s = SA.leave_one_out_splits(e, types, "label")
    return s.groupBy("held_out", "role").agg(F.count(F.lit(1)).alias("n"))


@query("label_shuffle_audit", "H-7", sel(SCORES + """,
a AS (SELECT id, y, row_number() OVER (ORDER BY id) AS r FROM scores WHERE k = 0), b AS (SELECT y AS yp, row_number() OVER (ORDER BY (id * 7919 + 7) % 10007, id) AS r FROM scores WHERE k = 0),
sh AS (SELECT model, p, yp AS y FROM scores JOIN a USING (id) JOIN b USING (r)),
""" + auc_sql("sh", "model"), "auc", "model", "auc"))
def _(spark, sf):
    ids = T.score_matrix(spark, sf).select("id", "y")
    perm = SA.permuted(ids, "y").withColumnRenamed("y_permuted", "y")
    return rounded(M.roc_auc(T.scores(spark, sf).drop("y").join(perm, "id"), ["model"]))


@query("class_weights", "H-8", sel(FOLDS, "folds, range(5) t(k) WHERE k <> fold GROUP BY k", "CAST(k AS INTEGER) AS fold", [("count(*) FILTER (y = 0) / greatest(count(*) FILTER (y = 1), 1)::DOUBLE", "pos_weight")]))
def _(spark, sf):
    return rounded(SA.class_weights(series_folds(spark, sf), 5))


@query("case_weights", "H-8", sel(SCORES + ", v AS (SELECT id, any_value(y) AS y, avg((p > 0.5)::INT) AS c FROM scores GROUP BY 1), a AS (SELECT *, CASE WHEN y = 1 THEN c ELSE 1 - c END AS g FROM v)", "a", "id",
                                  [("0.1 + 0.9 * g", "w_confident"), ("CASE WHEN g < 0.5 THEN 10 ELSE 1 END", "w_hard"), ("1 + 3 * (g < 0.4)::INT", "w_weak")]))
def _(spark, sf):
    m = T.score_matrix(spark, sf).withColumn("c", F.size(F.filter("p", lambda x: x > 0.5)) / 64.0)
    g = F.when(F.col("y") == 1, F.col("c")).otherwise(1 - F.col("c"))
    w = SA.case_weights(g, g < 0.5, (g < 0.4).cast("double"))
    return rounded(m.select("id", *[c.alias(n) for n, c in w.items()]))


def labelled_vectors(spark, sf):
    y = T.embeddings(spark, sf).select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("y"))
    return vectors(spark, sf).join(y, "id")


@query("smote_tomek", "H-9")
def _(spark, sf):
    x = cut_lineage(SA.smote(labelled_vectors(spark, sf)))
    k = SA.remove_tomek_links(x)
    return k.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") < 0).alias("synthetic"))


@query("balanced_folds", "H-9")
def _(spark, sf):
    """Balancing inside every training part: rows of the held-out fold are neither neighbours nor partners."""
    k = cut_lineage(SA.balanced_folds(train_frame(spark, sf), K_FOLDS))
    return k.groupBy("without", "y").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("copy") > 0).alias("synthetic"))


@query("mixup", "H-10", sel("""e AS (SELECT vec_id AS id, (label = 0)::INT AS y, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings),
a AS (SELECT *, row_number() OVER (ORDER BY id) AS r FROM e), b AS (SELECT *, row_number() OVER (ORDER BY (id * 7919 + 42) % 10007, id) AS r FROM e),
m AS (SELECT a.id, b.id AS pid, ((a.id * 7919 + 42) % 10007) / 10007.0 AS lam, a.y, b.y AS py, a.v, b.v AS pv FROM a JOIN b USING (r))""", "m", "id, pid", ["lam", ("lam * y + (1 - lam) * py", "y"), ("lam * v + (1 - lam) * pv", "v0")]))
def _(spark, sf):
    m = SA.mixup(labelled_vectors(spark, sf))
    return rounded(m.select("id", "pid", "lam", "y", F.get("vec", F.lit(0)).alias("v0")))


_TAMPER = {"point": "CASE WHEN day_idx % 37 = 0 THEN f * 3 ELSE f END", "contextual": "CASE WHEN day_idx >= n_days // 4 AND day_idx < 3 * n_days // 4 AND day_idx % 7 < 2 THEN mu ELSE f END",
           "collective": "CASE WHEN day_idx >= n_days // 2 AND day_idx < n_days // 2 + 14 THEN mx ELSE f END", "scale_global": "f * 0.5", "zero_interval": "CASE WHEN day_idx >= n_days // 4 AND day_idx < n_days // 2 THEN 0 ELSE f END",
           "scale_local": "CASE WHEN day_idx >= n_days // 4 AND day_idx < 3 * n_days // 4 THEN f * 0.3 ELSE f END", "subtract_random": "greatest(f - ((series_id * 7919 + day_idx * 104729 + 42) % 10007) / 10007.0 * mu, 0)",
           "subtract_mean": "greatest(f - mu, 0)", "reverse_daily": "rev", "slight_scale": "f * 0.9", "cap_max": "least(f, mu)", "reduce_night": "CASE WHEN day_idx % 2 = 1 THEN f * 0.5 ELSE f END", "flatten": "(f + mu) / 2",
           "long_zero": "CASE WHEN day_idx >= 3 * n_days // 4 THEN 0 ELSE f END", "scale_down": "CASE WHEN day_idx >= n_days // 2 THEN f * 0.4 ELSE f END", "flatline": "CASE WHEN day_idx >= n_days // 2 THEN mu ELSE f END",
           "mixed": "CASE WHEN day_idx >= 3 * n_days // 4 THEN 0 WHEN day_idx >= n_days // 2 THEN f * 0.5 ELSE f END"}


@query("tampered_series", "H-11", sel(PANEL + """,
tm AS (SELECT *, avg(f) OVER (PARTITION BY series_id) AS mu, max(f) OVER (PARTITION BY series_id) AS mx FROM panel),
tr AS (SELECT a.*, b.f AS rev FROM tm a JOIN panel b ON a.series_id = b.series_id AND b.day_idx = a.n_days - 1 - a.day_idx),
ta AS (""" + " UNION ALL ".join(f"SELECT series_id, day_idx, '{a}' AS attack, CAST({e} AS DOUBLE) AS value FROM tr" for a, e in _TAMPER.items()) + ")", "ta GROUP BY ALL", "series_id, attack",
                                      [("avg(value)", "mean"), ("max(value)", "max"), ("sum(value * (day_idx + 1))", "position_sum")], 3))
def _(spark, sf):
    t = SA.tamper(T.filled(spark, sf))
    return rounded(t.groupBy("series_id", "attack").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.sum(F.col("value") * (F.col("day_idx") + 1)).alias("position_sum")), 3)


# ---------------------------------------------------------------- learners

K_FOLDS = 5


def train_frame(spark, sf):
    """id, y, fold, features of the embedding rows, materialized: every fold reads it."""
    x = labelled_vectors(spark, sf)
    f = stratified_folds(x.select("id", "y"), K_FOLDS, "id").select("id", "fold")
    return cut_lineage(x.join(f, "id").withColumn("features", array_to_vector("vec")).select("id", "y", "fold", "features", "vec"))


def series_frame(spark, sf):
    """The scored series with their folds, in tasks that follow the number of series, as learners pass over them many times; the
    panel is made once."""
    x = cut_lineage(series_scored(spark, sf))
    f = stratified_folds(x.select("series_id", "y"), K_FOLDS).select("series_id", "fold")
    return gathered(x.join(f, "series_id").withColumnRenamed("series_id", "id"), "id")


@query("gbt_oof", "H-12, H-14")
def _(spark, sf):
    return rounded(L.oof(train_frame(spark, sf), lambda s: L.gbt(s), K_FOLDS), 5)


@query("boosted_styles", "H-12, H-14")
def _(spark, sf):
    """Leaf-wise, level-wise and symmetric boosters, stopped early, out of fold."""
    return rounded(binary(B.oof(train_frame(spark, sf), B.STYLES, K_FOLDS)), 5)


def binary(scores):
    return scores.withColumn("y", F.col("y").cast("int"))


def pool_of_four(x, folds, vec="vec"):
    """Long scores of a random forest, extra trees, leaf-wise boosting and logistic regression, out of fold."""
    s = L.oof_many(x, {"forest": lambda s: L.forest(s, 50, 8), "logistic": lambda s: L.logistic(s)}, folds).select("id", "y", "fold", "model", "p")
    edges = B.bin_edges(x, vec)
    boosted = B.oof(x, {"boosted": B.STYLES["leaf_wise"]}, folds, edges=edges, vec=vec)
    extra = X.oof(x, X.Forest(trees=50), folds, edges=edges, vec=vec).withColumn("model", F.lit("extra_trees"))
    return s.unionByName(binary(boosted)).unionByName(binary(extra))


@query("learner_pool", "H-13, H-14")
def _(spark, sf):
    return rounded(pool_of_four(train_frame(spark, sf), K_FOLDS), 5)


@query("leaf_indices", "H-15")
def _(spark, sf):
    """Out of fold: the leaves of every row come from trees that did not see it; two styles, padded to the same length."""
    rows, fitted = B.fit(train_frame(spark, sf), {k: B.STYLES[k] for k in ("leaf_wise", "level_wise")}, K_FOLDS)
    return B.out_of_fold(rows, fitted, leaves=B.STYLES["leaf_wise"].rounds).select("id", "fold", "model", "leaves")


@query("cohort_learners", "H-16")
def _(spark, sf):
    x = L.with_features(with_subgroup_of(series_frame(spark, sf)), ["mean", "std", "missing_rate", "low_ratio"])
    return rounded(L.by_group(cut_lineage(x), "grp", 5, lambda s: L.forest(s, 20, 5), K_FOLDS), 5)


@query("distilled_student", "H-17")
def _(spark, sf):
    """A shallow booster on labels mixed with a teacher's out-of-fold scores."""
    x = train_frame(spark, sf)
    teacher = L.oof(x, lambda s: L.forest(s, 50, 8), K_FOLDS).select("id", F.col("p").alias("t"))
    soft = cut_lineage(x.join(teacher, "id").withColumn("hard", F.col("y")).withColumn("y", 0.3 * F.col("y") + 0.7 * F.col("t")))
    s = B.oof(soft, {"student": B.Style("level", depth=3)}, K_FOLDS).select("id", "fold", "p")
    return rounded(s.join(soft.select("id", F.col("hard").alias("y")), "id"), 5)


FEATURE_SETS = {"level": ("mean", "max", "log_max"), "spread": ("std", "max"), "gaps": ("missing_rate", "low_ratio"), "all": tuple(FEATS)}


@query("learner_grid", "H-18")
def _(spark, sf):
    """Four algorithms on four feature sets; the best set of each algorithm. All boosters are grown in the same passes."""
    x = series_frame(spark, sf)
    parts = None
    for name, cols in FEATURE_SETS.items():
        s = L.oof(L.with_features(x, list(cols)), lambda s: L.forest(s, 50, 8), K_FOLDS).select("id", "y", "p", F.lit("forest").alias("algorithm"), F.lit(name).alias("feature_set"))
        parts = s if parts is None else parts.unionByName(s)
    vec = x.select("id", "y", "fold", F.array(*[F.col(c).cast("double") for c in FEATS]).alias("vec"))
    grid = {f"{a} {name}": replace(style, columns=tuple(FEATS.index(c) for c in cols)) for a, style in B.STYLES.items() for name, cols in FEATURE_SETS.items()}
    s = binary(B.oof(vec, grid, K_FOLDS)).select("id", "y", "p", F.split("model", " ")[0].alias("algorithm"), F.split("model", " ")[1].alias("feature_set"))
    a = rounded(M.roc_auc(cut_lineage(parts.unionByName(s)), ["algorithm", "feature_set"]))
    return a.groupBy("algorithm").agg(F.max_by(F.struct("feature_set", "auc"), F.struct("auc", "feature_set")).alias("b")).select("algorithm", "b.*")


@query("error_predictor", "H-19")
def _(spark, sf):
    x = train_frame(spark, sf)
    base = L.oof(x, lambda s: L.logistic(s), K_FOLDS).select("id", F.col("p").alias("base"))
    e = cut_lineage(x.join(base, "id").withColumn("y", ((F.col("base") > 0.15).cast("int") != F.col("y")).cast("int")))
    return rounded(L.oof(e, lambda s: L.forest(s, 50, 8), K_FOLDS, out="p_error"), 5)


def with_scores(x, scores, models):
    """The vectors with the out-of-fold scores of `models` behind them."""
    return cut_lineage(x.join(L.widen(scores, models), "id").withColumn("vec", F.concat(F.col("vec").cast("array<double>"), F.array(*models))))


@query("layered_stack", "H-20")
def _(spark, sf):
    """Four base learners, a booster on features and their scores, logistic regression on all scores."""
    x, names = train_frame(spark, sf), ["forest", "extra_trees", "boosted", "logistic"]
    one = cut_lineage(pool_of_four(x, K_FOLDS))
    two = binary(B.oof(with_scores(x, one, names), {"second": B.STYLES["leaf_wise"]}, K_FOLDS))
    three = L.stack(cut_lineage(one.unionByName(two)), x, [*names, "second"], lambda s: L.logistic(s), K_FOLDS, with_raw=False)
    return rounded(three, 5)


@query("feature_rich_meta", "H-21")
def _(spark, sf):
    x, names = train_frame(spark, sf), ["forest", "extra_trees", "boosted", "logistic"]
    base = cut_lineage(pool_of_four(x, K_FOLDS))
    meta = binary(B.oof(with_scores(x, base, names), {"meta": B.STYLES["symmetric"]}, K_FOLDS)).drop("model")
    lr = base.where("model = 'logistic'").select("id", F.col("p").alias("p_lr"))
    return rounded(meta.join(lr, "id").withColumn("hybrid", 0.6 * F.col("p") + 0.4 * F.col("p_lr")), 5)


@query("group_ablation", "H-22")
def _(spark, sf):
    return rounded(L.ablation(series_frame(spark, sf), {"level": ["mean", "max"], "spread": ["std"], "gaps": ["missing_rate", "low_ratio"]}, lambda s: L.logistic(s), K_FOLDS))


@query("meta_learners", "K-15")
def _(spark, sf):
    m = T.score_matrix(spark, sf)
    f = stratified_folds(m.select("id", "y"), K_FOLDS, "id").select("id", "fold")
    x = cut_lineage(m.join(f, "id").withColumn("features", array_to_vector("p")).select("id", "y", "fold", "features", F.col("p").alias("vec")))
    s = cut_lineage(pool_of_four(x, K_FOLDS))
    return rounded(M.roc_auc(s, ["model"]).join(M.best_f1(s, ["model"]), "model"))


@query("score_calibration", "K-20")
def _(spark, sf):
    x = series_frame(spark, sf)
    lr = L.oof(L.with_features(x, ["p", "log_max", "missing_rate"]), lambda s: L.logistic(s), K_FOLDS, out="p_logistic")
    iso = ISO.calibrated(x, K_FOLDS).select("id", F.col("p").alias("p_isotonic"), "raw")
    return rounded(lr.join(iso, "id"), 5)


@query("isotonic_calibration", "K-20", sel(SERIES + ",\n" + FOLDS.removeprefix(LABELS + ",\n") + """,
x AS MATERIALIZED (SELECT ss.series_id AS id, ss.y, round(p, 12) AS p, fold FROM ss JOIN folds USING (series_id)),
ag AS (SELECT m, p, sum(y) AS a, count(*) AS n FROM x, range(5) t(m) WHERE m <> fold GROUP BY m, p),
cu AS MATERIALIZED (SELECT m, p, a, n, row_number() OVER w AS i, sum(a) OVER w AS ca, sum(n) OVER w AS cn FROM ag WINDOW w AS (PARTITION BY m ORDER BY p)),
st AS (SELECT s.m, t.i, min((t.ca - s.ca + s.a) / (t.cn - s.cn + s.n)::DOUBLE) OVER (PARTITION BY s.m, s.i ORDER BY t.i DESC) AS low FROM cu s JOIN cu t ON s.m = t.m AND t.i >= s.i),
kn AS MATERIALIZED (SELECT m, p, max(low) AS v FROM st JOIN cu USING (m, i) GROUP BY m, p),
lo AS (SELECT x.*, k.p AS lp, k.v AS lv FROM x ASOF LEFT JOIN kn k ON x.fold = k.m AND x.p >= k.p),
hi AS (SELECT lo.*, k.p AS hp, k.v AS hv FROM lo ASOF LEFT JOIN kn k ON lo.fold = k.m AND lo.p <= k.p)""", "hi", "id, y, CAST(fold AS INTEGER) AS fold", [("p", "raw"), ("coalesce(lv + (p - lp) / nullif(hp - lp, 0) * (hv - lv), lv, hv)", "calibrated")], 5))
def _(spark, sf):
    x = series_frame(spark, sf).withColumn("p", F.round("p", 12))
    return rounded(ISO.calibrated(x, K_FOLDS).withColumnRenamed("p", "calibrated"), 5)
