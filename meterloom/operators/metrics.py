"""Threshold search and evaluation of scores. Score tables are long: id, y (0/1), p and grouping columns (model, fold, ...).

Threshold questions read a histogram over the threshold grid, built with one map-side combined aggregation; after
that every table has (groups x grid) rows. Rank questions use `running_totals`, which never sorts a group in one task.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import div
from .ranking import exact_quantiles, running_totals

Grid = tuple[int, ...]                # start, stop (exclusive), step and, if not thousandths, the denominator
GRID: Grid = (50, 950, 5)
RECALL_GRID: Grid = (20, 950, 5)
FINE_GRID: Grid = (198, 19603, 98, 19800)  # 199 even steps from 0.01 to 0.99


def grid_size(g: Grid) -> int:
    return len(range(*g[:3]))


def grid_scale(g: Grid) -> float:
    return float(g[3]) if len(g) > 3 else 1000.0


def grid_value(g: Grid, j: Column) -> Column:
    return (F.lit(g[0]) + j * g[2]) / F.lit(grid_scale(g))


def grid_values(g: Grid) -> np.ndarray:
    return np.arange(*g[:3]) / grid_scale(g)


def grid_bucket(p: Column, g: Grid, inclusive: bool = False) -> Column:
    """How many grid thresholds lie below p (or at p, when inclusive): the score passes exactly those."""
    est = F.floor((p * grid_scale(g) - g[0]) / g[2]).cast("int")

    def passes(j):
        return grid_value(g, j) <= p if inclusive else grid_value(g, j) < p

    c = F.when(passes(est + 1), est + 2).when(passes(est), est + 1).when(passes(est - 1), est).otherwise(est - 1)
    return F.least(F.greatest(c, F.lit(0)), F.lit(grid_size(g)))


def threshold_table(scores: DataFrame, by: list[str] | None = None, grid: Grid = GRID, inclusive: bool = False) -> DataFrame:
    """tp, fp, fn, tn for every group and grid threshold."""
    by = list(by or [])
    keys = by or ["_g"]
    src = scores if by else scores.withColumn("_g", F.lit(0))
    h = src.groupBy(*keys, grid_bucket(F.col("p"), grid, inclusive).alias("b")).agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return table_from_histogram(h, keys, grid).drop(*([] if by else ["_g"]))


def table_from_histogram(h: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """Counts above every threshold from (keys, b, pos, neg) cells."""
    k = grid_size(grid)
    cells = h.groupBy(*keys).agg(F.collect_list(F.struct("b", "pos", "neg")).alias("h"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))  # at most k + 1 cells
    maps = {c: F.map_from_arrays(F.col("h")["b"], F.col("h")[c]).alias(f"m_{c}") for c in ("pos", "neg")}
    t = cells.select(*keys, "n_pos", "n_neg", *maps.values()).select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("j"))
    above = W.partitionBy(*keys).orderBy(F.col("j").desc()).rowsBetween(W.unboundedPreceding, -1)  # in the partitioning of the groups

    def over(c):
        return F.coalesce(F.sum(F.try_element_at(f"m_{c}", "j")).over(above), F.lit(0))

    t = t.select(*keys, "j", grid_value(grid, F.col("j")).alias("th"), over("pos").alias("tp"), over("neg").alias("fp"), "n_pos", "n_neg").where(F.col("j") < k)
    return t.withColumn("fn", F.col("n_pos") - F.col("tp")).withColumn("tn", F.col("n_neg") - F.col("fp"))


def f1_of(tp="tp", fp="fp", fn="fn") -> Column:
    return div(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn), 0)


def with_rates(t: DataFrame) -> DataFrame:
    return (t.withColumn("f1", f1_of()).withColumn("recall", div("tp", F.col("tp") + F.col("fn"), 0))
            .withColumn("precision", div("tp", F.col("tp") + F.col("fp"), 0)))


def first_best(t: DataFrame, by: list[str], objective: str, cols: list[str], allowed: Column, default_th: float = 0.5) -> DataFrame:
    """Row with the largest objective (> 0) among the allowed ones; the lowest threshold wins ties."""
    ok = allowed & (F.col(objective) > 0)
    best = F.max_by(F.when(ok, F.struct(F.col("th").alias("threshold"), *cols)), F.when(ok, F.struct(objective, -F.col("th"))))
    g = (t.groupBy(*by) if by else t.groupBy()).agg(best.alias("b"))
    return g.select(*by, F.coalesce("b.threshold", F.lit(default_th)).alias("threshold"), *[F.coalesce(f"b.{c}", F.lit(0.0)).alias(c) for c in cols])


def best_f1(scores: DataFrame, by: list[str] | None = None, grid: Grid = GRID, inclusive: bool = False, min_recall: float | None = None) -> DataFrame:
    by = list(by or [])
    t = with_rates(threshold_table(scores, by, grid, inclusive))
    allowed = (F.col("tp") + F.col("fp")) > 0
    if min_recall is not None:
        allowed = allowed & (F.col("recall") >= min_recall)
    return first_best(t, by, "f1", ["f1", "recall", "precision"], allowed)


def best_recall_at_fpr(scores: DataFrame, caps: list[float], by: list[str]) -> DataFrame:
    t = with_rates(threshold_table(scores, by)).withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps])))
    ok = ((F.col("tp") + F.col("fp")) > 0) & (F.col("fp") / F.greatest(F.col("n_neg"), F.lit(1)) <= F.col("cap")) & (F.col("recall") > 0)
    b = F.max_by(F.when(ok, F.struct("recall", "th", "f1")), F.when(ok, F.struct("recall", "f1", -F.col("th"))))
    return t.groupBy(*by, "cap").agg(b.alias("b")).select(*by, "cap", F.coalesce("b.recall", F.lit(0.0)).alias("recall"),
                                                         F.coalesce("b.th", F.lit(0.5)).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


def best_detection_rate(scores: DataFrame, by: list[str], prior: float | None = None) -> DataFrame:
    """Threshold with the largest posterior share of true positives among the flagged."""
    t = threshold_table(scores, by)
    pr = F.lit(prior) if prior is not None else F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    tpr, fpr = F.col("tp") / F.greatest(F.col("n_pos"), F.lit(1)), F.col("fp") / F.greatest(F.col("n_neg"), F.lit(1))
    t = t.withColumn("bdr", div(tpr * pr, tpr * pr + fpr * (1 - pr), 0))
    return first_best(t, by, "bdr", ["bdr"], (F.col("tp") + F.col("fp")) > 0)


def confusion(scores: DataFrame, by: list[str] | None = None, threshold: float | Column = 0.5, total_row: bool = False) -> DataFrame:
    th = F.lit(threshold) if isinstance(threshold, float) else threshold
    pred = (F.col("p") > th).cast("int")
    y = F.col("y")
    g = (scores.rollup(*by) if total_row else scores.groupBy(*by)) if by else scores.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(pred * y).alias("tp"), F.sum(pred * (1 - y)).alias("fp"), F.sum((1 - pred) * y).alias("fn"), F.sum((1 - pred) * (1 - y)).alias("tn"))


def classification_report(c: DataFrame) -> DataFrame:
    """F1, recall, precision, accuracy, Cohen's kappa and Matthews correlation from confusion counts."""
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    po = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return with_rates(c).withColumn("accuracy", po).withColumn("kappa", div(po - pe, 1 - pe, 0)).withColumn("mcc", div(tp * tn - fp * fn, den, 0))


def roc_auc(scores: DataFrame, by: list[str] | None = None, few_groups: bool | None = None) -> DataFrame:
    """Rank AUC with ties counted half; 0.5 when a class is missing."""
    by = list(by or [])
    r = running_totals(scores, "p", {"pos": F.col("y"), "neg": 1 - F.col("y")}, by, few_groups=few_groups)
    u = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    g = (r.groupBy(*by) if by else r.groupBy()).agg(F.coalesce(div(u, F.first("pos_all") * F.first("neg_all")), F.lit(0.5)).alias("auc"))
    return g


def curve_points(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One point per distinct score, from the highest down: tp, fp, recall, precision, fpr."""
    r = running_totals(scores, "p", {"pos": F.col("y"), "neg": 1 - F.col("y")}, by, descending=True)
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    return r.select(*(by or []), F.col("key").alias("score"), "pos", tp.alias("tp"), fp.alias("fp"), div(tp, "pos_all", 0).alias("recall"),
                    (tp / (tp + fp)).alias("precision"), div(fp, "neg_all", 0).alias("fpr"), "pos_all")


def average_precision(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    c = curve_points(scores, by)
    return (c.groupBy(*by) if by else c.groupBy()).agg(F.coalesce(F.sum(div("pos", "pos_all") * F.col("precision")), F.lit(0.0)).alias("ap"))


def evaluate(scores: DataFrame, by: list[str]) -> DataFrame:
    """AUC, AP, best F1 with its threshold, recall and precision per group."""
    return roc_auc(scores, by).join(average_precision(scores, by), by).join(best_f1(scores, by), by)


def policy_value(scores: DataFrame, by: list[str], shares: tuple[float, ...] = (.01, .05, .1, .2), id_col: str = "id") -> DataFrame:
    """Precision, recall and lift among the top k = max(round(share * n), 1) rows, ordered by score then id."""
    key = F.struct((-F.col("p")).alias("np"), F.col(id_col).alias("i"))
    r = running_totals(scores, key, {"c": F.lit(1), "pos": F.col("y")}, by, collapsed=True)
    r = r.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    k = F.greatest(F.bround(F.col("share") * F.col("c_all"), 0).cast("bigint"), F.lit(1))
    t = r.withColumn("k", k).where("c_before < k").groupBy(*by, "share").agg(F.first("k").alias("k"), F.sum("pos").alias("hits"), F.first("pos_all").alias("_p"), F.first("c_all").alias("_n"))
    prec = F.col("hits") / F.col("k")
    return t.select(*by, "share", "k", prec.alias("precision"), (F.col("hits") / F.greatest(F.col("_p"), F.lit(1))).alias("recall"), (prec / F.greatest(F.col("_p") / F.col("_n"), F.lit(1e-8))).alias("lift"))


def effect_report(df: DataFrame, normal: str, treated: str, score: str) -> DataFrame:
    """Score gap between the arms, factual squared error and mean / deviation of the estimated effect."""
    y = F.col("y")
    obs = F.when(y == 1, F.col(treated)).otherwise(F.col(normal))
    ite = F.col(treated) - F.col(normal)
    gap = F.coalesce(F.avg(F.when(y == 1, F.col(score))) - F.avg(F.when(y == 0, F.col(score))), F.lit(0.0))
    return df.agg(gap.alias("ate_gap"), F.avg((y - obs) * (y - obs)).alias("factual_mse"), F.avg(ite).alias("ite_mean"), F.stddev_pop(ite).alias("ite_std"))


def fold_summary(m: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Mean, sample deviation and range of every metric over folds (long form)."""
    long = m.unpivot(by + ["fold"], metrics, "metric", "v")
    return long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def subgroup_edges(df: DataFrame, cov: str, groups: int = 5) -> Column:
    """Inner quantile edges of a covariate as a scalar struct."""
    return exact_quantiles(df, cov, {f"e{i}": i / groups for i in range(1, groups)}).select(F.struct(*[f"e{i}" for i in range(1, groups)]).alias("e")).scalar()


def with_subgroup(df: DataFrame, cov: str, groups: int = 5) -> DataFrame:
    """group 0..groups-1; a value on an edge belongs to the lower group (right-closed)."""
    x = df.withColumn("_e", subgroup_edges(df, cov, groups))
    g = F.lit(0)
    for i in range(1, groups):
        g = g + (F.col(cov) > F.col(f"_e.e{i}")).cast("int")
    return x.withColumn("grp", g).drop("_e")


def ceiling_at_recall(scores: DataFrame, targets: list[float], by: list[str]) -> DataFrame:
    """Best reachable F1 when the k-th best positive sets the threshold, k = floor(P * target)."""
    r = running_totals(scores, "p", {"pos": F.col("y"), "neg": 1 - F.col("y")}, by, descending=True)
    r = r.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets]))).withColumn("k", F.floor(F.col("pos_all") * F.col("target") + 1e-9))
    at = F.least(F.col("k"), F.col("pos_all") - 1)
    hit = r.where((F.col("pos_before") <= at) & (at < F.col("pos_before") + F.col("pos")))
    fp, fn = F.col("neg_before") + F.col("neg"), F.col("pos_all") - F.col("k")
    return hit.select(*by, "target", F.col("key").alias("threshold"), F.col("k").alias("tp"), fp.alias("fp"), fn.alias("fn"), div(2 * F.col("k"), 2 * F.col("k") + fp + fn, 0).alias("f1"))


def ntile(df: DataFrame, value: str, id_col: str, tiles: int) -> DataFrame:
    """Equal-count tiles over the whole table without a global sort in one task: id, tile."""
    key = F.struct(F.col(value).alias("v"), F.col(id_col).alias("i"))
    r = running_totals(df, key, {"c": F.lit(1)}, collapsed=True)
    q, rem = F.floor(F.col("c_all") / tiles), F.col("c_all") % tiles
    pos = F.col("c_before")
    t = F.when(pos < rem * (q + 1), F.floor(pos / (q + 1))).otherwise(rem + F.floor((pos - rem * (q + 1)) / F.greatest(q, F.lit(1))))
    return r.select(F.col("key.i").alias(id_col), (t + 1).cast("int").alias("tile"))


def student_two_sided(t: Column, dof: int) -> Column:
    """Two-sided Student p-value by the finite trigonometric series."""
    th = F.atan(F.abs(t) / math.sqrt(dof))
    s, c2 = F.sin(th), F.cos(th) * F.cos(th)
    if dof % 2 == 0:
        term, tot = F.lit(1.0), F.lit(1.0)
        for j in range(1, dof // 2):
            term = term * c2 * ((2 * j - 1) / (2 * j))
            tot = tot + term
        a = s * tot
    else:
        term, tot = F.cos(th), F.lit(0.0)
        for j in range((dof - 1) // 2):
            if j:
                term = term * c2 * (2 * j / (2 * j + 1))
            tot = tot + term
        a = (th + s * tot) * (2 / math.pi)
    return 1 - a


def paired_tests(m: DataFrame, a: str, b: str, folds: int, test_train: float) -> DataFrame:
    """Paired t, corrected resampled t, signed-rank statistic and Cohen d over folds. m: metric, fold, a, b."""
    d = m.withColumn("d", F.round(F.col(a) - F.col(b), 9))
    nzero = d.where("d <> 0")
    w = W.partitionBy("metric").orderBy(F.abs("d"))
    tie = F.count(F.lit(1)).over(W.partitionBy("metric", F.abs("d")))
    rk = nzero.withColumn("r", F.rank().over(w) + (tie - 1) / 2.0).groupBy("metric").agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("wp"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("wn"))
    g = d.groupBy("metric").agg(F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    g = g.join(rk, "metric", "left")
    t = div("mean_diff", F.col("sd") * math.sqrt(1 / folds), 0)
    tc = div("mean_diff", F.col("sd") * math.sqrt(1 / folds + test_train), 0)
    return g.select("metric", "mean_diff", t.alias("t_paired"), student_two_sided(t, folds - 1).alias("p_paired"), tc.alias("t_corrected"), student_two_sided(tc, folds - 1).alias("p_corrected"),
                    F.coalesce(F.least("wp", "wn"), F.lit(0.0)).alias("signed_rank"), div("mean_diff", "sd", 0).alias("cohen_d"))


def mcnemar(df: DataFrame, a: str, b: str, threshold: float = 0.5) -> DataFrame:
    """Discordant counts and the continuity-corrected statistic of two scores on the same rows."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:  # chi-square with one degree of freedom, one row
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)))

    ra, rb = (F.col(a) > threshold).cast("int") == F.col("y"), (F.col(b) > threshold).cast("int") == F.col("y")
    g = df.agg(F.count_if(ra & ~rb).alias("only_a"), F.count_if(~ra & rb).alias("only_b"))
    diff = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    g = g.withColumn("chi2", div(diff * diff, F.col("only_a") + F.col("only_b"), 0))
    return g.withColumn("p_value", tail("chi2"))
