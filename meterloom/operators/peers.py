"""Features that compare a series with its peers, and low-rank residuals."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import avg_if, clip
from .neighbours import cosine_graph
from .panel import DAY, ID
from .ranking import exact_quantiles, global_quantiles, grouped_quantiles, mean_ranks


def level_bins(means: DataFrame, m: str = "m", bins: int = 5) -> DataFrame:
    """Left-closed bins by the inner quantiles of the positive means."""
    ps = {f"e{i}": i / bins for i in range(1, bins)}
    x = means.withColumn("_e", global_quantiles(means.where(F.col(m) > 0), m, ps))
    b = F.lit(0)
    for k in ps:
        b = b + (F.col(m) >= F.col(f"_e.{k}")).cast("int")
    return x.withColumn("bin", b).drop("_e")


def monthly_peer_deviation(df: DataFrame, v: str = "f", bins: int = 5, min_peers: int = 5) -> DataFrame:
    """|x - peer median| / peer IQR of the monthly mean and deviation, peers = same level bin (long form)."""
    means = df.groupBy(ID).agg(F.avg(v).alias("m"))
    b = level_bins(means, bins=bins).select(ID, "bin")
    m = df.groupBy(ID, F.month("dt").alias("month")).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).join(b, ID)
    long = m.unpivot([ID, "bin", "month"], ["mean", "std"], "stat", "x")
    q = exact_quantiles(long, "x", {"q1": .25, "q2": .5, "q3": .75}, by=["bin", "month", "stat"])  # 5 x 12 x 2 groups
    n = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    x = long.join(F.broadcast(q), ["bin", "month", "stat"]).join(F.broadcast(n), "bin")
    dev = F.abs(F.col("x") - F.col("q2")) / F.greatest(F.col("q3") - F.col("q1"), F.lit(1e-6))
    return x.select(ID, "month", "stat", F.when(F.col("n") >= min_peers, clip(dev, -10, 10)).otherwise(0.0).alias("deviation"))


def cluster_profiles(weeks: DataFrame, k: int = 6, seed: int = 42) -> DataFrame:
    """K-means on weekly z-profiles: series_id, cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    a = weeks.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("week", "week_z"))).alias("_a"))
    x = a.select(ID, array_to_vector(F.transform("_a", lambda e: e["week_z"])).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(x)
    return model.transform(x).select(ID, F.col("prediction").alias("cluster"))


def cluster_ratio(means: DataFrame, clusters: DataFrame, m: str = "m") -> DataFrame:
    """Mean of a series over the median mean of its cluster."""
    x = means.join(clusters, ID)
    q = exact_quantiles(x, m, {"med": .5}, by=["cluster"])
    return x.join(F.broadcast(q), "cluster").select(ID, "cluster", (F.col(m) / (F.col("med") + 1e-6)).alias("peer_dev"))


def cluster_day_deviation(df: DataFrame, clusters: DataFrame, v: str = "f") -> DataFrame:
    """Daily medians per cluster and the mean absolute / low-share deviation of each series from them."""
    x = df.join(clusters, ID)
    q = grouped_quantiles(x, v, {"med": .5}, by=["cluster", DAY])  # clusters x days rows
    x = x.join(F.broadcast(q), ["cluster", DAY])
    return x.groupBy(ID, "cluster").agg(F.avg(F.abs(F.col(v) - F.col("med"))).alias("abs_dev"), F.avg((F.col(v) < F.col("med")).cast("double")).alias("below_share"))


def day_medians(df: DataFrame, v: str = "value") -> DataFrame:
    return grouped_quantiles(df, v, {"median": .5}, by=[DAY])


def global_rank(means: DataFrame, m: str = "m") -> DataFrame:
    r = mean_ranks(means, m)
    return means.join(r, F.col(m) == F.col("key")).select(ID, (F.col("rank") / F.col("n")).alias("global_rank"))


def normalize_scores(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min-max of every score over all rows (one row of bounds) and their mean."""
    b = df.agg(F.struct(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).alias("b")).scalar()
    x = df.withColumn("_b", b)
    for c in cols:
        lo, hi = F.col(f"_b.{c}_lo"), F.col(f"_b.{c}_hi")
        x = x.withColumn(f"{c}_n", F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0))
    return x.withColumn("combined", sum((F.col(f"{c}_n") for c in cols[1:]), F.col(f"{cols[0]}_n")) / len(cols)).drop("_b")


def _triangle(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """R of the QR factors of all rows of `blocks`, a few times its own height at a time."""
    r, held, size = None, [], 0

    def folded():
        return np.linalg.qr(np.vstack([*([r] if r is not None else []), *held]), mode="r")

    for x in blocks:
        held.append(x)
        size += len(x)
        if size >= 4 * x.shape[1]:
            r, held, size = folded(), [], 0
    return folded() if held else r


def triangular_factor(arrays: DataFrame, column: str = "x") -> np.ndarray:
    """R of the QR factorisation of all rows (QR of tall matrices in a tree): the singular values and right vectors of R are
    those of the rows, without the squared condition number of a Gram matrix. Its size is days x days, bounded by the
    calendar; each task holds two of them."""
    def emit(r):
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary()), pa.array([r.shape[1]], pa.int32())], ["r", "width"])

    def rows(batches):
        yield from emit(_triangle(np.array(b.column(0).to_pylist(), float) for b in batches if b.num_rows))

    def factors(batches):
        yield from emit(_triangle(np.frombuffer(x, float).reshape(-1, w) for b in batches for x, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())))

    r = arrays.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(rows, "r binary, width int")
    for tasks in (32, 1):
        r = r.repartition(tasks).mapInArrow(factors, "r binary, width int")
    got = r.first()
    return np.frombuffer(got.r, float).reshape(-1, got.width) if got else np.empty((0, 0))


def right_vectors(arrays: DataFrame, k: int) -> np.ndarray:
    """Top-k right singular vectors (days x k)."""
    return np.ascontiguousarray(np.linalg.svd(triangular_factor(arrays))[2][:k].T)


def low_rank_residual(arrays: DataFrame, v: np.ndarray) -> DataFrame:
    """residual = x - V V'x and the projection (latent), with V broadcast."""
    shared = arrays.sparkSession.sparkContext.broadcast(v)

    @F.pandas_udf("struct<residual:array<double>,latent:array<double>>")
    def split(xs: pd.Series) -> pd.DataFrame:
        x = np.stack(xs.to_numpy())
        z = x @ shared.value
        return pd.DataFrame({"residual": list(x - z @ shared.value.T), "latent": list(z)})

    return arrays.withColumn("_r", split("x")).select(ID, "x", "_r.residual", "_r.latent")


def residual_shape(res: DataFrame, bands: int = 5) -> DataFrame:
    """Norm, largest value, deviation, skewness, kurtosis and band energies of the residual; clipped to +-10."""
    long = res.select(ID, F.posexplode("residual").alias("k", "r"))
    g = long.groupBy(ID).agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"), F.max(F.abs("r")).alias("max_abs"), F.stddev_pop("r").alias("std"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"))

    @F.pandas_udf("array<double>")
    def energies(xs: pd.Series) -> pd.Series:
        def one(x):
            p = np.abs(np.fft.rfft(np.asarray(x, float)))[1:] ** 2
            size = max(1, len(p) // bands)
            return [p[b * size:(b + 1) * size].sum() / (p.sum() + 1e-10) for b in range(bands)]
        return xs.map(one)

    b = res.select(ID, energies("residual").alias("_e"))
    x = g.join(b, ID)
    return x.select(ID, *[clip(c, -10, 10).alias(c) for c in ("norm", "max_abs", "std", "skew", "kurt")], *[F.get("_e", F.lit(i)).alias(f"band_{i}") for i in range(bands)])


def reconstruction_errors(res: DataFrame, period: int = 12) -> DataFrame:
    """Squared residual: mean, thirds, by position in the year, largest; relative to the median error; latent norm and the
    distance to the nearest other latent vector (cosine, over all series)."""
    long = res.select(ID, F.size("residual").alias("n"), F.posexplode("residual").alias("k", "r")).withColumn("e", F.col("r") * F.col("r"))
    t = F.floor(F.col("n") / 3)
    k = F.col("k")
    g = long.groupBy(ID).agg(F.avg("e").alias("error"), avg_if("e", k < t).alias("error_first"), avg_if("e", (k >= t) & (k < 2 * t)).alias("error_mid"), avg_if("e", k >= 2 * t).alias("error_last"),
                             *[avg_if("e", F.floor(k % 52 * period / 52) == i).alias(f"error_season_{i + 1}") for i in range(period)], F.max("e").alias("error_max"))
    med = exact_quantiles(g, "error", {"m": .5}).select("m").scalar()
    lat = res.select(F.col(ID).alias("id"), F.col("latent").alias("vec"))
    near = cosine_graph(lat, 1).select(F.col("src").alias(ID), F.col("dist").alias("latent_nn"))
    norm = res.select(ID, F.sqrt(F.aggregate("latent", F.lit(0.0), lambda a, x: a + x * x)).alias("latent_norm"))
    x = g.withColumn("_m", med).withColumn("error_ratio", F.col("error") / (F.col("_m") + 1e-10)).drop("_m").join(norm, ID).join(near, ID, "left")
    return x.select(ID, *[clip(c, -10, 10).alias(c) for c in x.columns if c != ID])
