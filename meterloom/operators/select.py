"""Feature screening and selection. Features in long form: series_id, feature, value (and y)."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import metrics as M
from .pool import gram_array
from .ranking import running_totals


def screen(long: DataFrame) -> DataFrame:
    """AUC of every feature (flipped below 0.5) and its class means."""
    a = M.roc_auc(long.withColumnRenamed("value", "p"), ["feature"])
    m = long.groupBy("feature").agg(F.avg(F.when(F.col("y") == 1, F.col("value"))).alias("mean_pos"), F.avg(F.when(F.col("y") == 0, F.col("value"))).alias("mean_neg"))
    return a.join(m, "feature").select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"), (F.col("auc") < 0.5).alias("flipped"), "mean_pos", "mean_neg")


def varying(long: DataFrame, tol: float = 1e-10) -> DataFrame:
    """Features that are not constant, with their deviation."""
    return long.groupBy("feature").agg(F.stddev_samp("value").alias("std")).where(F.col("std") >= tol)


def drop_correlated(matrix: DataFrame, names: list[str], limit: float = 0.95) -> list[str]:
    """Of two features correlated above the limit the one of larger variance stays (earlier one on ties).

    matrix: p = ARRAY<DOUBLE> in the order of `names`; only the features x features sums reach the driver."""
    from .pool import with_ones

    g = gram_array(with_ones(matrix))
    n, s = g[0, 0], g[0, 1:]
    cov = g[1:, 1:] / n - np.outer(s, s) / n ** 2
    var = np.diag(cov)
    sd = np.sqrt(np.maximum(var, 1e-300))
    corr = cov / np.outer(sd, sd)
    gone: set[int] = set()
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            if i in gone:
                break
            if j not in gone and abs(corr[i, j]) > limit:
                gone.add(i if var[i] < var[j] else j)
    return [m for i, m in enumerate(names) if i not in gone]


def mutual_information(long: DataFrame, bins: int = 10, id_col: str = "series_id") -> DataFrame:
    """Mutual information between the label and equal-count bins of every feature."""
    key = F.struct(F.col("value").alias("v"), F.col(id_col).alias("i"))
    r = running_totals(long, key, {"c": F.lit(1), "pos": F.col("y")}, ["feature"], collapsed=True)
    b = r.withColumn("bin", F.floor(F.col("c_before") * bins / F.col("c_all")))
    c = b.groupBy("feature", "bin").agg(F.sum("c").alias("n"), F.sum("pos").alias("n1"), F.first("c_all").alias("t"), F.first("pos_all").alias("t1"))

    def term(nxy, ny):
        p = nxy / F.col("t")
        return F.when(nxy > 0, p * F.log(nxy * F.col("t") / (F.col("n") * ny))).otherwise(0.0)

    return c.groupBy("feature").agg(F.sum(term(F.col("n1"), F.col("t1")) + term(F.col("n") - F.col("n1"), F.col("t") - F.col("t1"))).alias("mi"))
