"""Split-conformal and selective classification."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import div
from .metrics import with_rates
from .pool import cell_sum, packed
from .ranking import running_totals

ALPHAS = (.01, .02, .05, .08, .10, .12, .15, .20, .25, .30)


def true_class_score(p="p", y="y") -> Column:
    """1 - probability of the true class."""
    return F.when(F.col(y) == 1, 1 - F.col(p)).otherwise(F.col(p))


def level(n: Column, alpha: Column) -> Column:
    return F.least(F.ceil((n + 1) * (1 - alpha) - 1e-9) / n, F.lit(1.0))


def conformal_quantiles(cal: DataFrame, alphas=ALPHAS, by: list[str] | None = None, score: str = "s", linear: bool = False) -> DataFrame:
    """q_hat per group and alpha: the order statistic at ceil(q (n-1)), or the linear quantile."""
    by = list(by or [])
    r = running_totals(cal, score, {"c": F.lit(1)}, by)
    r = r.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    rank = level(F.col("c_all"), F.col("alpha")) * (F.col("c_all") - 1)
    lo, hi = F.floor(rank + 1e-9), F.ceil(rank - 1e-9)
    inside = lambda at: (F.col("c_before") <= at) & (at < F.col("c_before") + F.col("c"))
    r = r.withColumn("_hi", F.when(inside(hi), F.col("key"))).withColumn("_lo", F.when(inside(lo), F.col("key"))).withColumn("_f", rank - lo)
    g = r.where("_hi is not null or _lo is not null").groupBy(*by, "alpha").agg(F.max("_hi").alias("_hi"), F.max("_lo").alias("_lo"), F.first("_f").alias("_f"), F.first("c_all").alias("n_cal"))
    q = F.col("_lo") + F.greatest(F.col("_f"), F.lit(0.0)) * (F.col("_hi") - F.col("_lo")) if linear else F.col("_hi")
    return g.select(*by, "alpha", "n_cal", q.alias("q_hat"))


def prediction_set(p: Column, q: Column) -> Column:
    return F.array_compact(F.array(F.when(p <= q, F.lit(0)), F.when(1 - p <= q, F.lit(1))))


def coverage_curve(test: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """Coverage and abstention per group and alpha. q has (groups x alphas) rows."""
    x = test.join(F.broadcast(q), by)
    s = prediction_set(F.col("p"), F.col("q_hat"))
    return x.groupBy(*by, "alpha").agg(F.first("q_hat").alias("q_hat"), F.avg(F.array_contains(s, F.col("y")).cast("double")).alias("coverage"),
                                       F.avg((F.size(s) != 1).cast("double")).alias("abstention"))


def recommend_alpha(curve: DataFrame, target: float, by: list[str]) -> DataFrame:
    """First alpha whose coverage is closest to the target."""
    b = F.min_by(F.struct("alpha", "coverage", "q_hat"), F.struct(F.round(F.abs(F.col("coverage") - target), 9), "alpha"))
    return curve.groupBy(*by).agg(b.alias("b")).select(*by, F.col("b.alpha").alias("alpha"), F.col("b.coverage").alias("coverage"), F.col("b.q_hat").alias("q_hat"))


def block_coverage(scored: DataFrame, alpha: float, n_folds: int, by: list[str]) -> DataFrame:
    """Coverage of every fold with the quantile calibrated on the other folds."""
    cal = scored.withColumn("_t", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col("fold")))) \
        .select(*by, F.col("_t").alias("fold"), "s")
    q = conformal_quantiles(cal, (alpha,), by + ["fold"])
    x = scored.join(F.broadcast(q), by + ["fold"])
    return x.groupBy(*by, "fold").agg(F.first("n_cal").alias("cal_size"), F.count(F.lit(1)).alias("test_size"),
                                      F.avg(F.array_contains(prediction_set(F.col("p"), F.col("q_hat")), F.col("y")).cast("double")).alias("coverage"))


def cost_aware(cal: DataFrame, test: DataFrame, ratios: list[float], alphas: list[float], c_fp: float = 500, c_fn: float = 24000,
               c_review: float = 200, base_th: float = 0.74) -> DataFrame:
    """Asymmetric scores (false alarms weighted by the ratio), automatic decisions, review share, total cost and saving."""
    rat = F.explode(F.array(*[F.lit(float(r)) for r in ratios]))
    s = cal.withColumn("ratio", rat).withColumn("s", F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p") * F.col("ratio")))
    q = conformal_quantiles(s, alphas, ["ratio"], linear=True)
    packed = q.agg(F.collect_list(F.struct("ratio", "alpha", "q_hat")).alias("g")).scalar()  # ratios x alphas entries
    x = test.withColumn("_g", packed).select("y", "p", F.explode("_g").alias("g")).select("y", "p", "g.*")
    low, high = F.col("p") <= F.col("q_hat"), (1 - F.col("p")) <= F.col("q_hat")
    pred = F.when(low & ~high, 0).when(high & ~low, 1)
    y = F.col("y")
    g = x.groupBy("ratio", "alpha").agg(F.first("q_hat").alias("tau"), F.count(F.lit(1)).alias("n"), F.count_if(pred.isNull()).alias("n_review"),
                                        F.count_if((pred == 1) & (y == 1)).alias("tp"), F.count_if((pred == 1) & (y == 0)).alias("fp"), F.count_if((pred == 0) & (y == 1)).alias("fn"),
                                        F.count_if((pred == 0) & (y == 0)).alias("tn"), F.count_if(pred.isNull() & (y == 1)).alias("fn_review"),
                                        F.count_if((F.col("p") > base_th) & (y == 0)).alias("_bfp"), F.count_if((F.col("p") <= base_th) & (y == 1)).alias("_bfn"))
    cost = F.col("fp") * c_fp + F.col("fn") * c_fn + F.col("n_review") * c_review
    base = F.col("_bfp") * c_fp + F.col("_bfn") * c_fn
    return with_rates(g).withColumn("review_rate", F.col("n_review") / F.col("n")).withColumn("total_cost", cost).withColumn("cost_saving", base - cost) \
        .withColumn("fn_cost_reduction", (F.col("_bfn") - F.col("fn")) * c_fn / F.greatest(F.col("_bfn") * c_fn, F.lit(1.0))).drop("_bfp", "_bfn")


def gate_table(scores: DataFrame, gates: list[float], correction: float = 0.9) -> DataFrame:
    """Automatic decisions outside the gate, review inside it, and the system after review corrects a share of the errors."""
    gates = sorted(gates)
    p, y = F.col("p"), F.col("y")
    # a row is described by how many gates it passes upwards and downwards: one small two-dimensional histogram
    up = sum(((p >= float(g)).cast("int") for g in gates), F.lit(0))
    down = sum(((p <= 1 - float(g)).cast("int") for g in gates), F.lit(0))
    h = scores.groupBy(up.alias("u"), down.alias("d")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"),
                                                           F.count_if(((y == 1) & (p < 0.5)) | ((y == 0) & (p >= 0.5))).alias("err"))
    x = scores.sparkSession.createDataFrame([(i, float(g)) for i, g in enumerate(gates)], "gi int, gate double").withColumn("h", packed(h))
    is_up = lambda c: c["u"] > F.col("gi")
    is_down = lambda c: (c["d"] > F.col("gi")) & ~is_up(c)
    is_rev = lambda c: ~is_up(c) & ~is_down(c)
    every = lambda c: F.lit(True)
    t = x.select("gate", (cell_sum(every, "pos") + cell_sum(every, "neg")).alias("n"), cell_sum(is_up, "pos").alias("tp"), cell_sum(is_up, "neg").alias("fp"),
                 cell_sum(is_down, "pos").alias("fn"), cell_sum(is_down, "neg").alias("tn"), cell_sum(is_rev, "pos").alias("review_pos"),
                 (cell_sum(is_rev, "pos") + cell_sum(is_rev, "neg")).alias("n_review"), cell_sum(every, "err").alias("errors"))
    fixed = F.floor(F.col("review_pos") * correction)
    t = with_rates(t).withColumnsRenamed({"f1": "auto_f1", "recall": "auto_recall", "precision": "auto_precision"})
    t = t.withColumn("review_rate", F.col("n_review") / F.col("n")).withColumn("error_capture", F.col("review_pos") / F.greatest(F.col("errors"), F.lit(1))) \
        .withColumn("sys_tp", F.col("tp") + fixed).withColumn("sys_fn", F.col("fn") + F.col("review_pos") - fixed)
    return t.withColumn("system_f1", div(2 * F.col("sys_tp"), 2 * F.col("sys_tp") + F.col("fp") + F.col("sys_fn"), 0))


def gate_for_budget(table: DataFrame, budgets: list[float]) -> DataFrame:
    """The gate whose review rate is nearest to each budget (lowest gate on ties)."""
    b = table.withColumn("budget", F.explode(F.array(*[F.lit(float(x)) for x in budgets])))
    m = F.min_by(F.struct("gate", "review_rate", "auto_f1"), F.struct(F.round(F.abs(F.col("review_rate") - F.col("budget")), 9), "gate"))
    return b.groupBy("budget").agg(m.alias("m")).select("budget", "m.*")
