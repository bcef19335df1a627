"""Evaluation, thresholds, conformal and selective classification (inventory J and the reported tables)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import conformal as CF, metrics as M, series_stats as S, subgroup as SG
from ..operators.folds import mixed, series_labels, stratified_folds
from ..operators.ranking import exact_quantiles
from ..session import cut_lineage
from ..sources import tables as T
from .catalog import query
from .sqlbase import LABELS, PANEL, SCORES, rnd, sel

# ---------------------------------------------------------------- shared SQL


def grid_sql(src: str, by: str, lo: int = 50, hi: int = 950, step: int = 5, op: str = ">", cte: str = "grid") -> str:
    n = len(range(lo, hi, step))
    keys = f"{by}, " if by else ""
    return f"""{cte}_a AS (SELECT {keys}({lo} + {step} * j) / 1000.0::DOUBLE AS th, count(*) FILTER (p {op} ({lo} + {step} * j) / 1000.0::DOUBLE AND y = 1) AS tp, count(*) FILTER (p {op} ({lo} + {step} * j) / 1000.0::DOUBLE AND y = 0) AS fp,
  sum(y) AS n_pos, count(*) - sum(y) AS n_neg FROM {src}, range({n}) t(j) GROUP BY {keys}j),
{cte} AS MATERIALIZED (SELECT *, n_pos - tp AS fn, n_neg - fp AS tn, coalesce(2 * tp / nullif(2 * tp + fp + n_pos - tp, 0)::DOUBLE, 0) AS f1, coalesce(tp / nullif(n_pos, 0)::DOUBLE, 0) AS recall, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision FROM {cte}_a)"""


def best_sql(by: str, where: str = "tp + fp > 0", obj: str = "f1", cols: str = "f1, recall, precision", cte: str = "best", grid: str = "grid") -> str:
    keys = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    b = f"arg_max(struct_pack(th := th, {", ".join(f"{c.strip()} := {c.strip()}" for c in cols.split(","))}), struct_pack(a := {obj}, b := -th)) FILTER ({where} AND {obj} > 0)"
    out = ", ".join(f"coalesce(bst.{c.strip()}, 0) AS {c.strip()}" for c in cols.split(","))
    return f"{cte}_a AS (SELECT {keys}{b} AS bst FROM {grid} {grp}),\n{cte} AS (SELECT {keys}coalesce(bst.th, 0.5) AS threshold, {out} FROM {cte}_a)"


def auc_sql(src: str, by: str, cte: str = "auc") -> str:
    part, keys, grp = (f"PARTITION BY {by}", f"{by}, ", f"GROUP BY {by}") if by else ("", "", "")
    comma = "," if by else "PARTITION BY"
    return f"""{cte}_r AS (SELECT {keys}y, rank() OVER ({part} ORDER BY p) + (count(*) OVER ({part}{comma} p) - 1) / 2.0 AS r FROM {src}),
{cte} AS (SELECT {keys}coalesce((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 0.5) AS auc FROM {cte}_r {grp})"""


def curve_sql(src: str, by: str, cte: str = "curve") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""{cte}_d AS (SELECT {keys}p AS score, sum(y) AS pos, count(*) - sum(y) AS neg FROM {src} GROUP BY {keys}p),
{cte} AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({part}) AS pp, sum(neg) OVER ({part}) AS nn FROM {cte}_d WINDOW w AS ({part} ORDER BY score DESC))"""


def ap_sql(by: str, cte: str = "ap") -> str:
    keys, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"{cte} AS (SELECT {keys}coalesce(sum(pos / nullif(pp, 0)::DOUBLE * tp / (tp + fp)), 0) AS ap FROM curve {grp})"


ID_FOLDS = """idf AS (SELECT vec_id AS id, CAST((row_number() OVER (PARTITION BY (label = 0) ORDER BY (vec_id * 7919 + 42) % 10007, vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings)"""


def scored_folds(spark, sf, models=None):
    s = T.scores(spark, sf) if models is None else T.scores(spark, sf).where(F.col("model").isin(models))
    ids = T.embeddings(spark, sf).select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("y"))
    return s.join(stratified_folds(ids, 5, "id").select("id", "fold"), "id")


# ---------------------------------------------------------------- J-1 .. J-13


@query("rank_auc", "J-1", sel(SCORES + ",\n" + auc_sql("scores", "model"), "auc", "model", "auc"))
def _(spark, sf):
    return rounded(M.roc_auc(T.scores(spark, sf), ["model"]))


@query("best_f1_threshold", "J-2", sel(SCORES + ",\n" + grid_sql("scores", "model") + ",\n" + best_sql("model"), "best", "model", "threshold, f1, recall, precision"))
def _(spark, sf):
    return rounded(M.best_f1(T.scores(spark, sf), ["model"]))


@query("best_f1_inclusive", "J-2", sel(SCORES + ",\n" + grid_sql("scores", "model", 10, 995, 5, ">=") + ",\n" + best_sql("model"), "best", "model", "threshold, f1, recall, precision"))
def _(spark, sf):
    return rounded(M.best_f1(T.scores(spark, sf), ["model"], grid=(10, 995, 5), inclusive=True))


@query("best_f1_recall_floor", "J-3", sel(SCORES + ",\n" + grid_sql("scores", "model", 20) + ",\n" + best_sql("model", "tp + fp > 0 AND recall >= 0.9"), "best", "model", "threshold, f1, recall, precision"))
def _(spark, sf):
    return rounded(M.best_f1(T.scores(spark, sf), ["model"], grid=M.RECALL_GRID, min_recall=0.9))


@query("recall_at_fpr", "J-4", sel(SCORES + ",\n" + grid_sql("scores", "model") + """,
r AS (SELECT model, cap, arg_max(struct_pack(recall, th, f1), struct_pack(a := recall, b := f1, c := -th)) FILTER (tp + fp > 0 AND recall > 0 AND fp / greatest(n_neg, 1)::DOUBLE <= cap) AS b
  FROM grid, (VALUES (0.005::DOUBLE), (0.01), (0.015), (0.02)) t(cap) GROUP BY ALL)""", "r", "model", ["cap", ("coalesce(b.recall, 0)", "recall"), ("coalesce(b.th, 0.5)", "threshold"), ("coalesce(b.f1, 0)", "f1")]))
def _(spark, sf):
    return rounded(M.best_recall_at_fpr(T.scores(spark, sf), [.005, .01, .015, .02], ["model"]))


@query("detection_rate_threshold", "J-5", sel(SCORES + ",\n" + grid_sql("scores", "model") + """,
bd AS (SELECT *, n_pos / (n_pos + n_neg)::DOUBLE AS pr, coalesce(tp / greatest(n_pos, 1)::DOUBLE * (n_pos / (n_pos + n_neg)::DOUBLE) / nullif(tp / greatest(n_pos, 1)::DOUBLE * (n_pos / (n_pos + n_neg)::DOUBLE)
  + fp / greatest(n_neg, 1)::DOUBLE * (1 - n_pos / (n_pos + n_neg)::DOUBLE), 0), 0) AS bdr FROM grid),
""" + best_sql("model", obj="bdr", cols="bdr", grid="bd"), "best", "model", "threshold, bdr"))
def _(spark, sf):
    return rounded(M.best_detection_rate(T.scores(spark, sf), ["model"])).select("model", "threshold", "bdr")


CONF = SCORES + """,
conf AS (SELECT model, count(*) AS n, count(*) FILTER (p > 0.5 AND y = 1) AS tp, count(*) FILTER (p > 0.5 AND y = 0) AS fp, count(*) FILTER (p <= 0.5 AND y = 1) AS fn, count(*) FILTER (p <= 0.5 AND y = 0) AS tn FROM scores GROUP BY 1)"""


@query("confusion_metrics", "J-6, J-7", sel(CONF + """,
e AS (SELECT *, (tp + tn) / n::DOUBLE AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)::DOUBLE AS pe, sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS den FROM conf)""", "e", "model, n, tp, fp, fn, tn",
                                            [("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)", "f1"), ("coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", "recall"), ("coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", "precision"),
                                             ("po", "accuracy"), ("coalesce((po - pe) / nullif(1 - pe, 0), 0)", "kappa"), ("coalesce((tp * tn - fp * fn) / nullif(den, 0), 0)", "mcc")]))
def _(spark, sf):
    return rounded(M.classification_report(M.confusion(T.scores(spark, sf), ["model"])))


@query("average_precision", "J-8", sel(SCORES + ",\n" + curve_sql("scores", "model") + ",\n" + ap_sql("model"), "ap", "model", "ap"))
def _(spark, sf):
    return rounded(M.average_precision(T.scores(spark, sf), ["model"]))


@query("curve_points", "J-8", sel(SCORES + ",\n" + curve_sql("scores", "model"), "curve", "model, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp",
                                  [("score", "score"), ("tp / pp", "recall"), ("tp / (tp + fp)", "precision"), ("fp / nn", "fpr")]))
def _(spark, sf):
    return rounded(M.curve_points(T.scores(spark, sf), ["model"]).drop("pos", "pos_all"))


@query("threshold_table", "J-9", sel(SCORES + ",\n" + grid_sql("scores", "model", 200, 700, 50), "grid", "model, tp, fp, CAST(fn AS BIGINT) AS fn", "th, f1, recall, precision"))
def _(spark, sf):
    t = M.with_rates(M.threshold_table(T.scores(spark, sf), ["model"], (200, 700, 50)))
    return rounded(t.select("model", "tp", "fp", "fn", "th", "f1", "recall", "precision"))


def components(spark, sf):
    w = T.wide_scores(spark, sf, [0, 1, 2])
    return w.select("id", "y", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.alias("p")) for n, c in (
        ("A", F.col("m0")), ("B", F.col("m1")), ("meta", F.col("m2")), ("mean_AB", (F.col("m0") + F.col("m1")) / 2))])).alias("s")).select("id", "y", "s.*")


COMPONENTS = SCORES + """,
comp AS MATERIALIZED (SELECT id, y, CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'meta' END AS model, p FROM scores WHERE k < 3
  UNION ALL SELECT id, any_value(y), 'mean_AB', (max(p) FILTER (k = 0) + max(p) FILTER (k = 1)) / 2 FROM scores WHERE k < 2 GROUP BY id)"""


@query("component_comparison", "J-10", sel(COMPONENTS + ",\n" + auc_sql("comp", "model") + ",\n" + curve_sql("comp", "model") + ",\n" + ap_sql("model") + ",\n" + grid_sql("comp", "model") + ",\n" + best_sql("model"),
                                           "auc JOIN ap USING (model) JOIN best USING (model)", "model", "auc, ap, threshold, f1, recall, precision"))
def _(spark, sf):
    return rounded(M.evaluate(components(spark, sf), ["model"]))


@query("main_results", "J-1, J-2, J-8, K-1", sel(SCORES + ",\n" + auc_sql("scores", "model") + ",\n" + curve_sql("scores", "model") + ",\n" + ap_sql("model") + ",\n" + grid_sql("scores", "model") + ",\n" + best_sql("model"),
                                                 "auc JOIN ap USING (model) JOIN best USING (model)", "model", "auc, ap, threshold, f1, recall, precision"))
def _(spark, sf):
    return rounded(M.evaluate(T.scores(spark, sf), ["model"]))


_FS = SCORES + ",\n" + ID_FOLDS + ",\nsf AS MATERIALIZED (SELECT scores.*, fold FROM scores JOIN idf USING (id))"


@query("fold_metrics", "J-11", sel(_FS + ",\n" + auc_sql("sf", "model, fold") + ",\n" + grid_sql("sf", "model, fold") + ",\n" + best_sql("model, fold") + """,
lm AS (SELECT model, fold, 'auc' AS metric, auc AS v FROM auc UNION ALL SELECT model, fold, 'f1', f1 FROM best UNION ALL SELECT model, fold, 'recall', recall FROM best UNION ALL SELECT model, fold, 'precision', precision FROM best)""",
                                   "lm GROUP BY ALL", "model, metric", [("avg(v)", "mean"), ("stddev_samp(v)", "std"), ("min(v)", "lo"), ("max(v)", "hi")]))
def _(spark, sf):
    s = scored_folds(spark, sf)
    m = M.roc_auc(s, ["model", "fold"]).join(M.best_f1(s, ["model", "fold"]), ["model", "fold"])
    return rounded(M.fold_summary(m, ["auc", "f1", "recall", "precision"], ["model"]))


@query("policy_value", "J-12", sel(SCORES + """,
r AS (SELECT model, y, p, row_number() OVER (PARTITION BY model ORDER BY p DESC, id) AS r, count(*) OVER (PARTITION BY model) AS n, sum(y) OVER (PARTITION BY model) AS pp FROM scores),
t AS (SELECT model, share, greatest(CAST(round_even(share * any_value(n), 0) AS BIGINT), 1) AS k, sum(y) FILTER (r <= greatest(CAST(round_even(share * n, 0) AS BIGINT), 1)) AS h, any_value(pp) AS pp, any_value(n) AS n
  FROM r, (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.2)) t(share) GROUP BY model, share)""", "t", "model, k", ["share", ("h / k::DOUBLE", "precision"), ("h / greatest(pp, 1)::DOUBLE", "recall"), ("h / k::DOUBLE / greatest(pp / n::DOUBLE, 1e-8)", "lift")]))
def _(spark, sf):
    return rounded(M.policy_value(T.scores(spark, sf), ["model"]))


@query("effect_report", "J-13", sel(SCORES + """,
w AS (SELECT id, any_value(y) AS y, max(p) FILTER (k = 0) AS a, max(p) FILTER (k = 1) AS b, max(p) FILTER (k = 2) AS c FROM scores GROUP BY 1)""", "w", "",
                                    [("avg(c) FILTER (y = 1) - avg(c) FILTER (y = 0)", "ate_gap"), ("avg((y - CASE WHEN y = 1 THEN b ELSE a END) ** 2)", "factual_mse"), ("avg(b - a)", "ite_mean"), ("stddev_pop(b - a)", "ite_std")]))
def _(spark, sf):
    return rounded(M.effect_report(T.wide_scores(spark, sf, [0, 1, 2]), "m0", "m1", "m2"))


# ---------------------------------------------------------------- J-14 .. J-18

_ALPHA = ", ".join(f"({a}::DOUBLE)" for a in CF.ALPHAS)
SPLIT = SCORES + f""",
sc AS MATERIALIZED (SELECT *, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s, (id * 7919 + 42) % 10007 < 5003 AS cal FROM scores),
cr AS (SELECT model, s, row_number() OVER (PARTITION BY model ORDER BY s) - 1 AS r, count(*) OVER (PARTITION BY model) AS n FROM sc WHERE cal),
qh AS MATERIALIZED (SELECT model, alpha, any_value(n) AS n_cal, max(s) FILTER (r = CAST(ceil(least(ceil((n + 1) * (1 - alpha) - 1e-9) / n, 1) * (n - 1) - 1e-9) AS BIGINT)) AS q_hat FROM cr, (VALUES {_ALPHA}) t(alpha) GROUP BY ALL)"""
_CURVE = SPLIT + """,
cv AS MATERIALIZED (SELECT model, alpha, any_value(q_hat) AS q_hat, avg((CASE WHEN y = 1 THEN 1 - p <= q_hat ELSE p <= q_hat END)::INT) AS coverage, avg(((p <= q_hat)::INT + (1 - p <= q_hat)::INT <> 1)::INT) AS abstention FROM sc JOIN qh USING (model) WHERE NOT cal GROUP BY ALL)"""


def split(spark, sf):
    s = T.scores(spark, sf).withColumn("s", CF.true_class_score())
    cal = mixed("id") < 5003
    return s.where(cal), s.where(~cal)


@query("conformal_quantiles", "J-14", sel(SPLIT, "qh", "model, n_cal", "alpha, q_hat"))
def _(spark, sf):
    return rounded(CF.conformal_quantiles(split(spark, sf)[0], by=["model"]))


@query("coverage_curve", "J-15", sel(_CURVE, "cv", "model", "alpha, q_hat, coverage, abstention"))
def _(spark, sf):
    cal, test = split(spark, sf)
    return rounded(CF.coverage_curve(test, CF.conformal_quantiles(cal, by=["model"]), ["model"]))


@query("prediction_sets", "J-15", "WITH " + SPLIT + """ SELECT id, model, concat_ws(',', CASE WHEN p <= q_hat THEN '0' END, CASE WHEN 1 - p <= q_hat THEN '1' END) AS classes FROM sc JOIN qh USING (model) WHERE NOT cal AND alpha = 0.1""")
def _(spark, sf):
    cal, test = split(spark, sf)
    q = CF.conformal_quantiles(cal, (0.1,), ["model"])
    return test.join(F.broadcast(q), "model").select("id", "model", F.array_join(CF.prediction_set(F.col("p"), F.col("q_hat")).cast("array<string>"), ",").alias("classes"))


@query("recommended_alpha", "J-15", sel(_CURVE + ", ra AS (SELECT model, arg_min(struct_pack(alpha, coverage, q_hat), struct_pack(a := round(abs(coverage - 0.9), 9), b := alpha)) AS b FROM cv GROUP BY 1)", "ra", "model", [("b.alpha", "alpha"), ("b.coverage", "coverage"), ("b.q_hat", "q_hat")]))
def _(spark, sf):
    cal, test = split(spark, sf)
    return rounded(CF.recommend_alpha(CF.coverage_curve(test, CF.conformal_quantiles(cal, by=["model"]), ["model"]), 0.9, ["model"]))


@query("block_coverage", "J-16", sel(_FS + """,
s2 AS (SELECT *, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM sf),
cr AS (SELECT model, t.fold, s, row_number() OVER (PARTITION BY model, t.fold ORDER BY s) - 1 AS r, count(*) OVER (PARTITION BY model, t.fold) AS n FROM s2, range(5) t(fold) WHERE t.fold <> s2.fold),
q AS (SELECT model, fold, any_value(n) AS cal_size, max(s) FILTER (r = CAST(ceil(least(ceil((n + 1) * 0.9 - 1e-9) / n, 1) * (n - 1) - 1e-9) AS BIGINT)) AS q_hat FROM cr GROUP BY ALL)""", "s2 JOIN q ON q.model = s2.model AND q.fold = s2.fold GROUP BY ALL",
                                     "s2.model, s2.fold, any_value(cal_size) AS cal_size, count(*) AS test_size", [("avg((s <= q_hat)::INT)", "coverage")]))
def _(spark, sf):
    s = scored_folds(spark, sf).withColumn("s", CF.true_class_score())
    return rounded(CF.block_coverage(s, 0.1, 5, ["model"]))


RATIOS, CALPHAS = [1.0, 2.0, 5.0, 10.0, 20.0, 47.94], [.01, .025, .05, .075, .10, .125, .15, .20, .25, .30]


@query("cost_aware_conformal", "J-17", sel(SCORES + f""",
bl AS (SELECT id, any_value(y) AS y, avg(p) AS p, (id * 7919 + 42) % 10007 < 5003 AS cal FROM scores WHERE k < 3 GROUP BY id),
cs AS (SELECT ratio, CASE WHEN y = 1 THEN 1 - p ELSE p * ratio END AS s FROM bl, (VALUES {", ".join(f"({r}::DOUBLE)" for r in RATIOS)}) t(ratio) WHERE cal),
cr AS (SELECT ratio, s, row_number() OVER (PARTITION BY ratio ORDER BY s) - 1 AS r, count(*) OVER (PARTITION BY ratio) AS n FROM cs),
rk AS (SELECT *, least(ceil((n + 1) * (1 - alpha) - 1e-9) / n, 1) * (n - 1) AS k FROM cr, (VALUES {", ".join(f"({a}::DOUBLE)" for a in CALPHAS)}) t(alpha)),
tq AS (SELECT ratio, alpha, max(s) FILTER (r = floor(k + 1e-9)) + greatest(any_value(k - floor(k + 1e-9)), 0) * (max(s) FILTER (r = ceil(k - 1e-9)) - max(s) FILTER (r = floor(k + 1e-9))) AS tau FROM rk GROUP BY ALL),
x AS (SELECT ratio, alpha, tau, y, p, CASE WHEN p <= tau AND 1 - p > tau THEN 0 WHEN 1 - p <= tau AND p > tau THEN 1 END AS pred FROM bl, tq WHERE NOT cal),
g AS (SELECT ratio, alpha, any_value(tau) AS tau, count(*) AS n, count(*) FILTER (pred IS NULL) AS n_review, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp, count(*) FILTER (pred = 0 AND y = 1) AS fn,
  count(*) FILTER (pred = 0 AND y = 0) AS tn, count(*) FILTER (pred IS NULL AND y = 1) AS fn_review, count(*) FILTER (p > 0.74 AND y = 0) * 500 AS bfp, count(*) FILTER (p <= 0.74 AND y = 1) * 24000 AS bfn FROM x GROUP BY ALL)""", "g",
                                           "n, n_review, tp, fp, fn, tn, fn_review", ["ratio", "alpha", "tau", ("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)", "f1"), ("coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", "recall"),
                                                                                      ("coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", "precision"), ("n_review / n::DOUBLE", "review_rate"), ("fp * 500 + fn * 24000 + n_review * 200", "total_cost"),
                                                                                      ("bfp + bfn - (fp * 500 + fn * 24000 + n_review * 200)", "cost_saving"), ("(bfn - fn * 24000) / greatest(bfn, 1)::DOUBLE", "fn_cost_reduction")]))
def _(spark, sf):
    w = T.wide_scores(spark, sf, [0, 1, 2]).withColumn("p", (F.col("m0") + F.col("m1") + F.col("m2")) / 3)
    cal = mixed("id") < 5003
    r = CF.cost_aware(w.where(cal), w.where(~cal), RATIOS, CALPHAS)
    return rounded(r.withColumn("total_cost", F.col("total_cost").cast("double")).withColumn("cost_saving", F.col("cost_saving").cast("double")))


GATES = [i / 100 for i in range(50, 100)]
_GATE = SCORES + f""",
gx AS (SELECT gate, y, p, p >= gate AS up, p <= 1 - gate AND p < gate AS dn FROM scores, (VALUES {", ".join(f"({g}::DOUBLE)" for g in GATES)}) t(gate) WHERE k = 0),
gg AS (SELECT gate, count(*) AS n, count(*) FILTER (up AND y = 1) AS tp, count(*) FILTER (up AND y = 0) AS fp, count(*) FILTER (dn AND y = 1) AS fn, count(*) FILTER (dn AND y = 0) AS tn, count(*) FILTER (NOT up AND NOT dn AND y = 1) AS review_pos,
  count(*) FILTER (NOT up AND NOT dn) AS n_review, count(*) FILTER ((y = 1 AND p < 0.5) OR (y = 0 AND p >= 0.5)) AS errors FROM gx GROUP BY 1),
gt AS MATERIALIZED (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS auto_f1, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS auto_recall, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS auto_precision, n_review / n::DOUBLE AS review_rate,
  review_pos / greatest(errors, 1)::DOUBLE AS error_capture, tp + CAST(floor(review_pos * 0.9) AS BIGINT) AS sys_tp, fn + review_pos - CAST(floor(review_pos * 0.9) AS BIGINT) AS sys_fn FROM gg)"""


@query("gate_table", "J-18", sel(_GATE, "gt", "n, tp, fp, fn, tn, review_pos, n_review, errors, sys_tp, sys_fn", ["gate", "auto_f1", "auto_recall", "auto_precision", "review_rate", "error_capture", ("coalesce(2 * sys_tp / nullif(2 * sys_tp + fp + sys_fn, 0)::DOUBLE, 0)", "system_f1")]))
def _(spark, sf):
    return rounded(CF.gate_table(T.wide_scores(spark, sf, [0]).withColumnRenamed("m0", "p"), GATES))


@query("gate_for_budget", "J-18", sel(_GATE + """,
bb AS (SELECT budget, arg_min(struct_pack(gate, review_rate, auto_f1), struct_pack(a := round(abs(review_rate - budget), 9), b := gate)) AS m FROM gt, (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.3), (0.5)) t(budget) GROUP BY 1)""",
                                      "bb", "", ["budget", ("m.gate", "gate"), ("m.review_rate", "review_rate"), ("m.auto_f1", "auto_f1")]))
def _(spark, sf):
    t = CF.gate_table(T.wide_scores(spark, sf, [0]).withColumnRenamed("m0", "p"), GATES)
    return rounded(CF.gate_for_budget(t, [.05, .1, .2, .3, .5]))


# ---------------------------------------------------------------- J-19 .. J-27: series-level scores


def series_scored(spark, sf):
    """Series with label y, score p (mean level relative to the largest) and covariates."""
    lab = series_labels(spark, sf)
    base = T.panel(spark, sf).groupBy("series_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max"),
                                                      F.avg(F.col("is_missing").cast("double")).alias("missing_rate"), F.avg((F.coalesce("value", F.lit(0.0)) < 10).cast("double")).alias("low_ratio"))
    top = base.agg(F.max("mean").alias("m")).scalar()
    return (base.withColumn("_top", top).join(lab, "series_id").withColumn("p", F.pow(F.col("mean") / F.col("_top"), F.lit(8.0))).withColumn("log_max", F.log1p("max")).drop("_top"))


SERIES = PANEL + ",\n" + LABELS + """,
sb AS (SELECT series_id, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS max, avg(is_missing::INT) AS missing_rate, avg((f < 10)::INT) AS low_ratio FROM panel GROUP BY 1),
ss AS MATERIALIZED (SELECT sb.*, y, (mean / (SELECT max(mean) FROM sb)) ** 8 AS p, ln(1 + max) AS log_max FROM sb JOIN series_labels USING (series_id)),
sq AS (SELECT quantile_cont(log_max, [0.2, 0.4, 0.6, 0.8]) AS q FROM ss),
sg AS MATERIALIZED (SELECT ss.*, (log_max > q[1])::INT + (log_max > q[2])::INT + (log_max > q[3])::INT + (log_max > q[4])::INT AS grp FROM ss, sq)"""

SUB_GRID: M.Grid = (50, 900, 50)


@query("subgroup_table", "J-19", "WITH " + SERIES + ",\n" + grid_sql("sg", "grp", 50, 900, 50) + " SELECT grp, " + rnd("th") + " AS th, tp, fp, CAST(fn AS BIGINT) AS fn FROM grid")
def _(spark, sf):
    t = M.threshold_table(M.with_subgroup(series_scored(spark, sf), "log_max"), ["grp"], SUB_GRID)
    return rounded(t.select("grp", "th", "tp", "fp", "fn"))


def best_cuts_sql(kind: str, points: str, sweeps: int = 9) -> str:
    """Best cut of every group for the F1 of all, by repeated choice at the ratio reached so far (which ends after a few steps)."""
    out = f"{kind}0 AS (SELECT 0::HUGEINT AS a, 1::HUGEINT AS b)"
    for k in range(1, sweeps + 1):
        out += f""",
{kind}c{k} AS MATERIALIZED (SELECT grp, arg_max(struct_pack(th, n, tp), struct_pack(v := b * 2 * tp - a * n, few := -n)) AS t FROM {points}, {kind}{k - 1} GROUP BY grp),
{kind}{k} AS MATERIALIZED (SELECT 2 * sum(t.tp)::HUGEINT AS a, sum(t.n)::HUGEINT + (SELECT sum(y) FROM sg)::HUGEINT AS b FROM {kind}c{k})"""
    return out + f""",
{kind} AS (SELECT '{kind}' AS kind, CAST(c.grp AS INTEGER) AS grp, c.t.th AS threshold, f.a / f.b::DOUBLE AS f1, f.a / 2 / (SELECT sum(y) FROM sg)::DOUBLE AS recall, f.a / 2 / (SELECT sum(t.n) FROM {kind}c{sweeps})::DOUBLE AS precision FROM {kind}c{sweeps} c, {kind}{sweeps} f)"""


def grid_points_sql(cte: str, grid: str) -> str:
    return f"{cte} AS MATERIALIZED (SELECT grp, min(th)::DOUBLE AS th, (tp + fp)::HUGEINT AS n, tp::HUGEINT AS tp FROM {grid} WHERE tp + fp > 0 GROUP BY grp, tp, fp UNION ALL SELECT DISTINCT grp, NULL::DOUBLE, 0::HUGEINT, 0::HUGEINT FROM sg)"


def grouped(spark, sf):
    x = cut_lineage(M.with_subgroup(series_scored(spark, sf), "log_max").select("grp", F.round("p", 12).alias("p"), "y"))
    return x, x.agg(F.sum("y").cast("bigint")).first()[0]


@query("subgroup_thresholds", "J-19", "WITH " + SERIES + ",\n" + grid_sql("sg", "grp", 50, 900, 50, cte="g1") + ",\n" + grid_sql("sg", "grp", 50, 950, 10, cte="g2") + ",\n" + grid_points_sql("p1", "g1") + ",\n" + grid_points_sql("p2", "g2") + """,
p3 AS MATERIALIZED (SELECT DISTINCT grp, round(p, 12) AS th, (count(*) OVER w)::HUGEINT AS n, (sum(y) OVER w)::HUGEINT AS tp FROM sg WINDOW w AS (PARTITION BY grp ORDER BY round(p, 12) DESC) UNION ALL SELECT DISTINCT grp, NULL::DOUBLE, 0::HUGEINT, 0::HUGEINT FROM sg),
""" + ",\n".join(best_cuts_sql(k, f"p{i}") for i, k in enumerate(("coarse", "fine", "exact"), 1)) + " SELECT kind, grp, " + ", ".join(rnd(c) + f" AS {c}" for c in ("threshold", "f1", "recall", "precision")) + " FROM (SELECT * FROM coarse UNION ALL SELECT * FROM fine UNION ALL SELECT * FROM exact)")
def _(spark, sf):
    """The best cut of each group for the F1 of all: on two grids, and over every distinct score."""
    x, positives = grouped(spark, sf)
    grids = {"coarse": SUB_GRID, "fine": (50, 950, 10)}
    out = SG.best_thresholds(cut_lineage(SG.score_points(x)), positives, "exact")
    for kind, grid in grids.items():
        out = out.unionByName(SG.best_thresholds(cut_lineage(SG.grid_points(M.threshold_table(x, ["grp"], grid))), positives, kind))
    return rounded(out)


@query("subgroup_recall_floor", "J-19")
def _(spark, sf):
    """The same over every distinct score with a recall of at least 0.9; exact, see operators.subgroup."""
    x, positives = grouped(spark, sf)
    return rounded(SG.best_thresholds(cut_lineage(SG.score_points(x)), positives, "recall_floor", 0.9))


@query("subgroup_report", "J-20", sel(SERIES + """,
rp AS (SELECT grp, count(*) AS n, count(*) FILTER (p > 0.5 AND y = 1) AS tp, count(*) FILTER (p > 0.5 AND y = 0) AS fp, count(*) FILTER (p <= 0.5 AND y = 1) AS fn, count(*) FILTER (p <= 0.5 AND y = 0) AS tn FROM sg GROUP BY ROLLUP (grp))""", "rp", "grp, n, tp, fp, fn, tn",
                                      [("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)", "f1"), ("coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", "recall"), ("coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", "precision")]))
def _(spark, sf):
    x = M.with_subgroup(series_scored(spark, sf), "log_max")
    return rounded(M.with_rates(M.confusion(x, ["grp"], total_row=True)))


@query("per_type_metrics", "J-21", sel(SCORES + """,
ty AS (SELECT s.id, s.model, s.p, e.label FROM scores s JOIN embeddings e ON e.vec_id = s.id),
tx AS (SELECT t.type, model, p, (label = t.type)::INT AS y FROM ty, (SELECT DISTINCT label AS type FROM embeddings WHERE label <> 0) t WHERE label = t.type OR label = 0),
""" + auc_sql("tx", "model, type") + """,
rc AS (SELECT model, type, count(*) FILTER (y = 1 AND p > 0.5) / count(*) FILTER (y = 1)::DOUBLE AS recall, count(*) FILTER (y = 1) AS n_type FROM tx GROUP BY ALL)""", "auc JOIN rc USING (model, type)", "model, CAST(type AS INTEGER) AS type, n_type", "auc, recall"))
def _(spark, sf):
    # label 0 is the normal class; a typed row belongs to its own type, a normal row to every type
    lab = T.embeddings(spark, sf).select(F.col("vec_id").alias("id"), "label")
    kinds = lab.where("label <> 0").agg(F.collect_set("label").alias("kinds"))  # one row, a value for each type
    s = T.scores(spark, sf).drop("y").join(lab, "id").join(F.broadcast(kinds))
    x = s.withColumn("type", F.explode(F.when(F.col("label") == 0, F.col("kinds")).otherwise(F.array("label")))).withColumn("y", (F.col("label") == F.col("type")).cast("int"))
    r = x.groupBy("model", "type").agg((F.count_if((F.col("y") == 1) & (F.col("p") > 0.5)) / F.count_if(F.col("y") == 1)).alias("recall"), F.count_if(F.col("y") == 1).alias("n_type"))
    return rounded(M.roc_auc(x, ["model", "type"]).join(r, ["model", "type"]))


def outcome():
    pred = F.col("p") > 0.5
    return F.when(pred & (F.col("y") == 1), "TP").when(pred, "FP").when(F.col("y") == 1, "FN").otherwise("TN")


@query("error_cohorts", "J-22", sel(SERIES + ", oc AS (SELECT *, CASE WHEN p > 0.5 AND y = 1 THEN 'TP' WHEN p > 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM ss)", "oc GROUP BY 1", "outcome, count(*) AS n",
                                    [("avg(missing_rate)", "missing_rate"), ("avg(low_ratio)", "low_ratio"), ("avg(mean)", "mean"), ("avg(std)", "std"), ("avg(p)", "p_mean"), ("quantile_cont(p, 0.5)", "p_median")]))
def _(spark, sf):
    x = series_scored(spark, sf).withColumn("outcome", outcome())
    g = x.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("missing_rate", "low_ratio", "mean", "std")], F.avg("p").alias("p_mean"))
    return rounded(g.join(exact_quantiles(x, "p", {"p_median": .5}, by=["outcome"]), "outcome"))


@query("error_overlap", "J-22", sel(SCORES + """,
b AS (SELECT id, p AS pb FROM scores WHERE k = 0), e AS (SELECT s.*, pb FROM scores s JOIN b USING (id) WHERE k > 0)""", "e GROUP BY 1", "model, count(*) FILTER (y = 1 AND pb <= 0.5 AND p <= 0.5) AS fn_overlap, count(*) FILTER (y = 0 AND pb > 0.5 AND p > 0.5) AS fp_overlap",
                                    [("count(*) FILTER (y = 1 AND pb <= 0.5 AND p <= 0.5) / greatest(count(*) FILTER (y = 1 AND pb <= 0.5), 1)::DOUBLE", "fn_share"), ("count(*) FILTER (y = 0 AND pb > 0.5 AND p > 0.5) / greatest(count(*) FILTER (y = 0 AND pb > 0.5), 1)::DOUBLE", "fp_share")]))
def _(spark, sf):
    m = T.score_matrix(spark, sf).withColumn("pb", F.get("p", F.lit(0)))
    x = m.select("y", "pb", F.posexplode("p").alias("k", "p")).where("k > 0").withColumn("model", F.concat(F.lit("m"), "k"))
    fn, fp = (F.col("y") == 1) & (F.col("pb") <= 0.5), (F.col("y") == 0) & (F.col("pb") > 0.5)
    a, b = F.count_if(fn & (F.col("p") <= 0.5)), F.count_if(fp & (F.col("p") > 0.5))
    return rounded(x.groupBy("model").agg(a.alias("fn_overlap"), b.alias("fp_overlap"), (a / F.greatest(F.count_if(fn), F.lit(1))).alias("fn_share"), (b / F.greatest(F.count_if(fp), F.lit(1))).alias("fp_share")))


@query("missed_rescuable", "J-22", sel(SCORES + """,
fn AS (SELECT id, max(p) FILTER (k > 0) AS best, avg(p) FILTER (k > 0) AS mean, max(p) FILTER (k = 0) AS pb FROM scores WHERE y = 1 GROUP BY 1 HAVING max(p) FILTER (k = 0) <= 0.5)""", "fn", "count(*) AS n_fn, count(*) FILTER (best > 0.5) AS rescuable, count(*) FILTER (best <= 0.5) AS all_low",
                                       [("quantile_cont(pb, 0.25)", "q25"), ("quantile_cont(pb, 0.5)", "q50"), ("quantile_cont(pb, 0.75)", "q75")]))
def _(spark, sf):
    m = T.score_matrix(spark, sf).where("y = 1").withColumn("pb", F.get("p", F.lit(0))).where("pb <= 0.5")
    best = F.array_max(F.slice("p", 2, 63))
    g = m.agg(F.count(F.lit(1)).alias("n_fn"), F.count_if(best > 0.5).alias("rescuable"), F.count_if(best <= 0.5).alias("all_low"))
    q = exact_quantiles(m, "pb", {"q25": .25, "q50": .5, "q75": .75})
    return rounded(g.withColumn("_q", q.select(F.struct("q25", "q50", "q75").alias("q")).scalar()).select("n_fn", "rescuable", "all_low", "_q.*"))


@query("hard_cases", "J-23", sel(SCORES + """,
v AS (SELECT id, any_value(y) AS y, max(p) FILTER (k = 0) AS p, (count(*) FILTER (p > 0.5) >= 33)::INT AS clean FROM scores GROUP BY 1)""", "v", """count(*) FILTER ((p > 0.5)::INT <> y) AS errors, count(*) FILTER ((p > 0.5)::INT <> y AND y = clean) AS hard,
  count(*) FILTER (p <= 0.5 AND y = 1 AND clean = 1) AS hard_fn, count(*) FILTER (p > 0.5 AND y = 0 AND clean = 0) AS hard_fp, count(*) FILTER ((p > 0.5)::INT <> y AND y <> clean) AS label_noise""",
                                 [("count(*) FILTER ((p > 0.5)::INT <> y AND y <> clean) / greatest(count(*) FILTER ((p > 0.5)::INT <> y), 1)::DOUBLE", "noise_share")]))
def _(spark, sf):
    m = T.score_matrix(spark, sf)
    clean = (F.size(F.filter("p", lambda x: x > 0.5)) >= 33).cast("int")
    m = m.select("y", (F.get("p", F.lit(0)) > 0.5).cast("int").alias("h"), clean.alias("c"))
    wrong = F.col("h") != F.col("y")
    noise = F.count_if(wrong & (F.col("y") != F.col("c")))
    return rounded(m.agg(F.count_if(wrong).alias("errors"), F.count_if(wrong & (F.col("y") == F.col("c"))).alias("hard"), F.count_if(wrong & (F.col("y") == 1) & (F.col("c") == 1)).alias("hard_fn"),
                         F.count_if(wrong & (F.col("y") == 0) & (F.col("c") == 0)).alias("hard_fp"), noise.alias("label_noise"), (noise / F.greatest(F.count_if(wrong), F.lit(1))).alias("noise_share")))


TARGETS = [.80, .83, .85, .88, .90, .92, .95]


@query("recall_ceiling", "J-24", sel(SCORES + f""",
pr AS (SELECT model, p, row_number() OVER (PARTITION BY model ORDER BY p DESC) - 1 AS r, count(*) OVER (PARTITION BY model) AS n FROM scores WHERE y = 1),
th AS (SELECT model, target, CAST(floor(any_value(n) * target + 1e-9) AS BIGINT) AS k, any_value(n) AS n, max(p) FILTER (r = least(CAST(floor(n * target + 1e-9) AS BIGINT), n - 1)) AS threshold FROM pr, (VALUES {", ".join(f"({t}::DOUBLE)" for t in TARGETS)}) t(target) GROUP BY model, target),
fp AS (SELECT th.model, target, count(s.id) AS fp FROM th LEFT JOIN scores s ON s.model = th.model AND s.y = 0 AND s.p >= threshold GROUP BY ALL)""", "th JOIN fp USING (model, target)", "model, k AS tp, fp, n - k AS fn",
                                     ["target", "threshold", ("2 * k / (2 * k + fp + n - k)::DOUBLE", "f1")]))
def _(spark, sf):
    return rounded(M.ceiling_at_recall(T.scores(spark, sf), TARGETS, ["model"]))


_CONTRAST = ["mean", "std", "max", "missing_rate", "low_ratio", "q10", "q50", "q90"]


@query("class_contrast", "J-25", sel(SERIES + """,
qq AS (SELECT series_id, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.9) AS q90 FROM readings GROUP BY 1),
lo AS (""" + " UNION ALL ".join(f"SELECT y, '{c}' AS feature, {c} AS v FROM ss JOIN qq USING (series_id)" for c in _CONTRAST) + """),
md AS (SELECT feature, quantile_cont(v, 0.5) FILTER (y = 1) AS pos_median, quantile_cont(v, 0.5) FILTER (y = 0) AS neg_median FROM lo GROUP BY 1)""", "md", "feature", ["pos_median", "neg_median", ("pos_median / (neg_median + 1e-6)", "ratio")], 5))
def _(spark, sf):
    q = S.percentiles(T.readings(spark, sf), ps=(10, 50, 90))
    x = series_scored(spark, sf).join(q, "series_id")
    long = x.unpivot(["series_id", "y"], _CONTRAST, "feature", "v")
    m = exact_quantiles(long, "v", {"m": .5}, by=["feature", "y"]).groupBy("feature").agg(F.max(F.when(F.col("y") == 1, F.col("m"))).alias("pos_median"), F.max(F.when(F.col("y") == 0, F.col("m"))).alias("neg_median"))
    return rounded(m.withColumn("ratio", F.col("pos_median") / (F.col("neg_median") + 1e-6)), 5)


@query("monthly_contrast", "J-25", sel(PANEL + ",\n" + LABELS + """,
mm AS (SELECT series_id, y, CAST(month(dt) AS INTEGER) AS month, avg(value) AS a FROM panel JOIN series_labels USING (series_id) GROUP BY ALL),
md AS (SELECT month, quantile_cont(a, 0.5) FILTER (y = 1) AS pos_median, quantile_cont(a, 0.5) FILTER (y = 0) AS neg_median FROM mm GROUP BY 1)""", "md", "month", ["pos_median", "neg_median", ("pos_median / (neg_median + 1e-6)", "ratio")]))
def _(spark, sf):
    mm = T.readings(spark, sf).groupBy("series_id", F.month("dt").alias("month")).agg(F.avg("value").alias("a")).join(series_labels(spark, sf), "series_id")
    m = exact_quantiles(mm, "a", {"m": .5}, by=["month", "y"]).groupBy("month").agg(F.max(F.when(F.col("y") == 1, F.col("m"))).alias("pos_median"), F.max(F.when(F.col("y") == 0, F.col("m"))).alias("neg_median"))
    return rounded(m.withColumn("ratio", F.col("pos_median") / (F.col("neg_median") + 1e-6)))


@query("coverage_bins", "J-25", "WITH " + PANEL + ",\n" + LABELS + """, c AS (SELECT series_id, any_value(y) AS y, 1 - avg(is_missing::INT) AS q FROM panel JOIN series_labels USING (series_id) GROUP BY 1)
SELECT CAST((q >= 0.1)::INT + (q >= 0.3)::INT + (q >= 0.5)::INT + (q >= 0.7)::INT + (q >= 0.9)::INT AS INTEGER) AS bin, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM c GROUP BY 1""")
def _(spark, sf):
    x = series_scored(spark, sf).withColumn("q", 1 - F.col("missing_rate"))
    b = sum(((F.col("q") >= e).cast("int") for e in (.1, .3, .5, .7, .9)), F.lit(0))
    return x.groupBy(b.alias("bin")).agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))


@query("significance_tests", "J-26", sel(_FS + ",\n" + auc_sql("sf", "model, fold") + ",\n" + grid_sql("sf", "model, fold") + ",\n" + best_sql("model, fold") + """,
lm AS (SELECT model, fold, 'auc' AS metric, auc AS v FROM auc UNION ALL SELECT model, fold, 'f1', f1 FROM best),
d AS (SELECT metric, fold, round(max(v) FILTER (model = 'm1') - max(v) FILTER (model = 'm0'), 9) AS d FROM lm GROUP BY ALL),
rk AS (SELECT metric, d, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
w AS (SELECT metric, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS signed_rank FROM rk GROUP BY 1),
g AS (SELECT metric, avg(d) AS mean_diff, stddev_samp(d) AS sd, avg(d) / (stddev_samp(d) * sqrt(0.2)) AS t, avg(d) / (stddev_samp(d) * sqrt(0.2 + 0.25)) AS tc FROM d GROUP BY 1)""", "g LEFT JOIN w USING (metric)", "metric",
                                         ["mean_diff", ("t", "t_paired"), ("1 - sin(atan(abs(t) / 2)) * (1 + cos(atan(abs(t) / 2)) ** 2 / 2)", "p_paired"), ("tc", "t_corrected"), ("1 - sin(atan(abs(tc) / 2)) * (1 + cos(atan(abs(tc) / 2)) ** 2 / 2)", "p_corrected"), "signed_rank", ("mean_diff / sd", "cohen_d")], 5))
def _(spark, sf):
    s = scored_folds(spark, sf, ["m0", "m1"])
    m = M.roc_auc(s, ["model", "fold"]).join(M.best_f1(s, ["model", "fold"]), ["model", "fold"]).unpivot(["model", "fold"], ["auc", "f1"], "metric", "v")
    w = m.groupBy("metric", "fold").agg(F.max(F.when(F.col("model") == "m1", F.col("v"))).alias("a"), F.max(F.when(F.col("model") == "m0", F.col("v"))).alias("b"))
    return rounded(M.paired_tests(w, "a", "b", 5, 0.25), 5)


@query("mcnemar", "J-26", sel(SCORES + """,
w AS (SELECT id, any_value(y) AS y, (max(p) FILTER (k = 0) > 0.5)::INT AS a, (max(p) FILTER (k = 1) > 0.5)::INT AS b FROM scores GROUP BY 1),
g AS (SELECT count(*) FILTER (a = y AND b <> y) AS only_a, count(*) FILTER (a <> y AND b = y) AS only_b FROM w),
h AS (SELECT *, coalesce(greatest(abs(only_a - only_b) - 1, 0) ** 2 / nullif(only_a + only_b, 0), 0) AS chi2 FROM g)""", "h", "only_a, only_b", ["chi2", ("1 - sqrt(2 / pi()) * (sqrt(chi2) / 6000) * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(i * sqrt(chi2) / 2000, 2) / 2)))", "p_value")]))
def _(spark, sf):
    return rounded(M.mcnemar(T.wide_scores(spark, sf, [0, 1]), "m0", "m1"))


@query("volatility_terciles", "J-27", sel(SERIES + """,
nt AS (SELECT *, ntile(3) OVER (ORDER BY std / mean, series_id) AS tile FROM ss),
rp AS (SELECT CAST(tile AS INTEGER) AS tile, count(*) AS n, count(*) FILTER (p > 0.5 AND y = 1) AS tp, count(*) FILTER (p > 0.5 AND y = 0) AS fp, count(*) FILTER (p <= 0.5 AND y = 1) AS fn, count(*) FILTER (p <= 0.5 AND y = 0) AS tn FROM nt GROUP BY ROLLUP (tile))""", "rp", "tile, n, tp, fp, fn, tn",
                                          [("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)", "f1"), ("coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", "recall"), ("coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", "precision")]))
def _(spark, sf):
    x = series_scored(spark, sf).withColumn("cv", F.col("std") / F.col("mean"))
    return rounded(M.with_rates(M.confusion(x.join(M.ntile(x, "cv", "series_id", 3), "series_id"), ["tile"], total_row=True)))


@query("fold_confusion", "J-6", sel(_FS + ", cf AS (SELECT model, fold, count(*) AS n, count(*) FILTER (p > 0.5 AND y = 1) AS tp, count(*) FILTER (p > 0.5 AND y = 0) AS fp, count(*) FILTER (p <= 0.5 AND y = 1) AS fn, count(*) FILTER (p <= 0.5 AND y = 0) AS tn FROM sf GROUP BY ALL)",
                                    "cf", "model, fold, n, tp, fp, fn, tn", [("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)", "f1"), ("coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", "recall"), ("coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", "precision")]))
def _(spark, sf):
    return rounded(M.with_rates(M.confusion(scored_folds(spark, sf), ["model", "fold"])))


def with_subgroup_of(x):
    """Usage quintile of the largest value."""
    return M.with_subgroup(x, "log_max")
