"""Isolation forest: one small sample per tree is grown in a task, all rows are scored with the broadcast trees."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(safe - 1, 1)) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, cut, left, right, extra path) of one tree; leaves have feature -1."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    size = 1
    while todo:
        node, idx, depth = todo.pop()
        sub = x[idx]
        wide = np.flatnonzero(sub.max(0) > sub.min(0)) if len(idx) > 1 else np.empty(0, int)
        if depth >= limit or not wide.size:
            nodes.append((node, -1, 0.0, -1, -1, depth + float(average_path(len(idx)))))
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(sub[:, f].min(), sub[:, f].max()))
        left = sub[:, f] <= cut
        nodes.append((node, f, cut, size, size + 1, 0.0))
        todo += [(size, idx[left], depth + 1), (size + 1, idx[~left], depth + 1)]
        size += 2
    return nodes


def isolation_scores(df: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """Anomaly score 2^(-mean path / expected path) for id, vec; higher is more unusual."""
    n = df.count()
    take = min(sample, n)
    slots = max(1, int(n / (take * 1.5)))  # a row joins a tree with probability 1.5 take / n, then the first `take` stay
    member = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), t), F.lit(slots)) == 0)
    picked = df.select("id", "vec", F.explode(member).alias("tree"))
    w = W.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 1), "id", "tree"))
    picked = picked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= take)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        out = grow(np.stack(pdf.vec.to_numpy()), np.random.default_rng([seed, int(key[0])]))
        t = pd.DataFrame(out, columns=["node", "feature", "cut", "left", "right", "path"])
        t.insert(0, "tree", key[0])
        return t

    schema = "tree int, node int, feature int, cut double, left int, right int, path double"
    # trees x (2 x sample) nodes at most: a size fixed by the parameters
    nodes = picked.select("id", "vec", "tree").groupBy("tree").applyInPandas(build, schema).toPandas()
    forest = [g.sort_values("node")[["feature", "cut", "left", "right", "path"]].to_numpy() for _, g in nodes.groupby("tree")]
    expected = float(average_path(take))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(vs: pd.Series) -> pd.Series:
        x = np.stack(vs.to_numpy())
        total = np.zeros(len(x))
        for t in shared.value:
            at = np.zeros(len(x), int)
            while True:
                f = t[at, 0].astype(int)
                inner = f >= 0
                if not inner.any():
                    break
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1], t[at, 2], t[at, 3]).astype(int)
                at = np.where(inner, go, at)
            total += t[at, 4]
        return pd.Series(2.0 ** (-(total / len(shared.value)) / expected))

    return df.select("id", score("vec").alias("isolation"))
