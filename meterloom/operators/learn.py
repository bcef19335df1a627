"""Out-of-fold learners on Spark ML.

Frames have id, y, fold and a vector column `features`. Every fold is fitted on the other folds only, so no row is
scored by a model that saw it. The training frame should be materialized before (it is read once per fold).
"""
from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from . import metrics as M
from .folds import mixed

Factory = Callable[[int], Estimator]
#: Folds fitted at once.
FITS = 5


def gbt(seed: int, iters: int = 5, depth: int = 3, early_stop: bool = True, weight: str | None = None, leaf: str | None = None) -> GBTClassifier:
    g = GBTClassifier(labelCol="y", featuresCol="features", maxIter=iters, maxDepth=depth, seed=seed, stepSize=0.3, validationTol=0.001)
    if early_stop:
        g = g.setValidationIndicatorCol("holdout")
    if weight:
        g = g.setWeightCol(weight)
    return g.setLeafCol(leaf) if leaf else g


def forest(seed: int, trees: int = 10, depth: int = 4, weight: str | None = None) -> RandomForestClassifier:
    r = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return r.setWeightCol(weight) if weight else r


def logistic(seed: int, weight: str | None = None) -> LogisticRegression:
    lr = LogisticRegression(labelCol="y", featuresCol="features", regParam=0.01, maxIter=30)
    return lr.setWeightCol(weight) if weight else lr


def with_features(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols])))


def oof(df: DataFrame, make: Factory, folds: int, out: str = "p", keep: list[str] | None = None, id_col: str = "id", target: str = "classes") -> DataFrame:
    """id, y, fold and the out-of-fold score. `holdout` marks a tenth of the training rows for early stopping."""
    cols = [id_col, "y", "fold", *(keep or [])]
    train = [df.where(F.col("fold") != f).withColumn("holdout", mixed(id_col, 1000 + f) % 10 == 0) for f in range(folds)]

    def fitted(f: int):
        return inheritable_thread_target(df.sparkSession)(lambda: make(42 + f).fit(train[f]))()

    with ThreadPoolExecutor(max(1, min(folds, FITS))) as pool:  # a fit is many short jobs, which leave cores idle
        models = list(pool.map(fitted, range(folds)))
    parts = None
    for f, model in enumerate(models):
        scored = model.transform(df.where(F.col("fold") == f))
        p = F.get(vector_to_array("probability"), F.lit(1)) if target == "classes" else F.col("prediction")
        s = scored.select(*cols, p.cast("double").alias(out))
        parts = s if parts is None else parts.unionByName(s)
    return parts


def oof_many(df: DataFrame, makers: dict[str, Factory], folds: int, id_col: str = "id") -> DataFrame:
    """Scores of several learners in long form: id, y, fold, model, p."""
    parts = None
    for name, make in makers.items():
        s = oof(df, make, folds, id_col=id_col).withColumn("model", F.lit(name))
        parts = s if parts is None else parts.unionByName(s)
    return parts


def widen(scores: DataFrame, models: list[str], id_col: str = "id") -> DataFrame:
    return scores.groupBy(id_col).pivot("model", models).agg(F.first("p"))


def stack(base: DataFrame, features: DataFrame, models: list[str], make: Factory, folds: int, id_col: str = "id", with_raw: bool = True) -> DataFrame:
    """Second level on the raw features and the base scores."""
    w = widen(base, models, id_col)
    x = features.join(w, id_col)
    raw = vector_to_array("features") if with_raw else F.array()
    x = x.withColumn("features", array_to_vector(F.concat(raw.cast("array<double>"), F.array(*[F.col(m) for m in models]))))
    return oof(x, make, folds, id_col=id_col)


def by_group(df: DataFrame, group: str, groups: int, make: Factory, folds: int, id_col: str = "id") -> DataFrame:
    """One learner per group; a group without both classes in some training part is scored by its base rate."""
    cells = df.groupBy(group, "fold").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    # positives and negatives left for training when the fold with most of them is held out; groups x folds rows
    counts = {r[group]: r for r in cells.groupBy(group).agg(
        (F.sum("a") - F.max("a")).alias("m1"), (F.sum(F.col("n") - F.col("a")) - F.max(F.col("n") - F.col("a"))).alias("m0"),
        (F.sum("a") / F.sum("n")).alias("rate")).collect()}
    parts = None
    for g in range(groups):
        if g not in counts:
            continue
        sub = df.where(F.col(group) == g)
        c = counts[g]
        s = oof(sub, make, folds, keep=[group], id_col=id_col) if c.m1 > 0 and c.m0 > 0 else sub.select(id_col, "y", "fold", group, F.lit(float(c.rate)).alias("p"))
        parts = s if parts is None else parts.unionByName(s)
    return parts


def ablation(df: DataFrame, groups: dict[str, list[str]], make: Factory, folds: int, id_col: str = "id") -> DataFrame:
    """AUC with all column groups, without each one and with each one alone."""
    every = [c for cs in groups.values() for c in cs]
    sets = {"all": every} | {f"without_{g}": [c for c in every if c not in cs] for g, cs in groups.items()} | {f"only_{g}": cs for g, cs in groups.items()}
    parts = None
    for name, cols in sets.items():
        s = oof(with_features(df, cols), make, folds, id_col=id_col).withColumn("model", F.lit(name))
        parts = s if parts is None else parts.unionByName(s)
    return M.roc_auc(parts, ["model"])
