"""Exact nearest neighbours without a cross join.

Rows are assigned to the nearest of m pivots and every cell is cut into blocks of bounded size, so a dense cell (many
near copies) becomes many blocks. For a query cell only the cells that can hold a neighbour are joined: from the radii
and counts an upper bound on the k-th distance follows, and cells farther away than that are left out (triangle
inequality). Candidates and queries are dealt into groups and shards of bounded size; a task takes one tile of the two,
multiplies the block pairs that are linked in it and keeps k candidates per query row; pairs are never emitted. So a row
is shuffled once for each tile in its row or column of tiles, a number that small inputs share and that grows by one for
each TILE_BYTES of vectors.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import pin

BLOCK_ROWS = 1024
SLAB_ROWS = 2048        # candidates that a query block is compared with at once
TILE_BYTES = 32 << 20   # vectors of a side of a tile
TILE_PAIRS = 1 << 24    # small inputs are cut into tiles of so many pairs, up to TILES of them
TILES = 64


def _pivots(df: DataFrame, m: int) -> np.ndarray:
    """m rows of smallest hash (a bounded top-m, the same on every run)."""
    rows = df.select("vec").orderBy(F.xxhash64("id"), "id").limit(m).collect()
    return np.array([r.vec for r in rows], float)


def _centre(df: DataFrame) -> np.ndarray:
    """Mean of every dimension (one small row each)."""
    return np.array([r.m for r in df.select(F.posexplode("vec").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").collect()])


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by the product form, and a bound of their rounding error. Both sides are centred."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    return aa[:, None] + bb[None] - 2 * a @ b.T, 4 * (a.shape[1] + 4) * np.finfo(float).eps * (aa.max(initial=0) + bb.max(initial=0))


def _assign(df: DataFrame, pivots: np.ndarray, centre: np.ndarray) -> DataFrame:
    @F.pandas_udf("struct<cell:int,r:double>")
    def nearest(vs: pd.Series) -> pd.DataFrame:
        x = np.stack(vs.to_numpy())
        c = _squares(x - centre, pivots - centre)[0].argmin(axis=1)  # any pivot will do, its distance must be right
        return pd.DataFrame({"cell": c.astype("int32"), "r": np.sqrt(((x - pivots[c]) ** 2).sum(1)) * (1 + 1e-12)})

    return df.withColumn("_c", nearest("vec")).select("id", "vec", "_c.cell", "_c.r")


def _measured(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of the pairs (row, col), by differences."""
    out = np.empty(len(row))
    for lo in range(0, len(row), 1 << 14):
        at = slice(lo, lo + (1 << 14))
        out[at] = np.sqrt(((q[row[at]] - c[col[at]]) ** 2).sum(-1))
    return out


def _nearest_of(q: np.ndarray, qi: np.ndarray, c: np.ndarray, ci: np.ndarray, slabs, k: int, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of `q`, ids and exact distances of their k nearest among the rows of `c` in `slabs` (places, least distance to any
    query), ties by id. The product form picks every candidate that could be one of them, within its rounding error; these
    are measured again."""
    row, near, dist = np.empty(0, np.int64), np.empty(0, ci.dtype), np.empty(0)
    kth = np.full(len(q), np.inf)
    for at, least in slabs:
        if least > kth.max() * (1 + 1e-9) + 1e-9:
            break  # slabs come by their least distance
        d, error = _squares(q - centre, c[at] - centre)
        own = np.flatnonzero(np.isin(ci[at], qi))
        if len(own):
            d[:, own] = np.where(qi[:, None] == ci[at][own][None], np.inf, d[:, own])
        limit = kth * kth * (1 + 1e-12) + 2 * error
        if len(at) >= k and np.isinf(kth).any():
            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * error)
        r, j = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        if not len(r):
            continue
        row, near, dist = np.r_[row, r], np.r_[near, ci[at][j]], np.r_[dist, _measured(q, c, r, at[j])]
        o = np.lexsort((near, dist, row))
        row, near, dist = row[o], near[o], dist[o]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, near, dist, place = (x[place < k] for x in (row, near, dist, place))
        kth[row[place == k - 1]] = dist[place == k - 1]
    return row, near, dist


def _cuts(n: int) -> int:
    return max(1, math.ceil(n / BLOCK_ROWS))


def _by_cell(values: dict, cell: str):
    none = type(next(iter(values.values())))(0)
    return F.get(F.array(*[F.lit(values.get(c, none)) for c in range(max(values) + 1)]), F.col(cell))


def _blocks(df: DataFrame, stats: dict[int, tuple[int, float]], names: tuple[str, str, str, str]) -> DataFrame:
    """One row per block: cell, block, ids and the flattened vectors."""
    b = df.withColumn("_b", F.pmod(F.xxhash64("id"), _by_cell({c: _cuts(n) for c, (n, _) in stats.items()}, "cell")))
    g = b.groupBy("cell", "_b").agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("_l"))
    return g.select(F.col("cell").alias(names[0]), F.col("_b").alias(names[1]), F.transform("_l", lambda e: e["id"]).alias(names[2]), F.flatten(F.transform("_l", lambda e: e["vec"])).alias(names[3]))


def _tiles(candidates: int, queries: int, width: int) -> tuple[int, int]:
    """Number of candidate groups and of query shards: a query row is sent to at most all groups, a candidate to all shards."""
    most = max(BLOCK_ROWS, TILE_BYTES // (8 * width))
    tiles = min(TILES, math.ceil(candidates * queries / TILE_PAIRS))
    groups = max(math.ceil(candidates / most), math.isqrt(tiles - 1) + 1)
    return groups, max(math.ceil(queries / most), math.ceil(tiles / groups))


def _chain(gap: np.ndarray) -> list[int]:
    """Cells in an order that goes from each to the nearest one left."""
    left, at, out = np.ones(len(gap), bool), 0, []
    while left.any():
        left[at] = False
        out.append(at)
        at = int(np.where(left, gap[at], np.inf).argmin())
    return out


def _places(stats: dict[int, tuple[int, float]], order: list[int], parts: int) -> dict[int, tuple[float, float, int, int]]:
    """cell -> place of its first block and step from block to block, in parts of equal size along `order`; first and last part."""
    total, before, out = sum(n for n, _ in stats.values()), 0, {}
    for c in order:
        if c in stats:
            n = stats[c][0]
            first, step = before * parts / total, n * parts / total / _cuts(n)
            out[c] = (first, step, min(parts - 1, int(first)), min(parts - 1, int(first + step * (_cuts(n) - 1))))
            before += n
    return out


def _part(places: dict[int, tuple[float, float, int, int]], cell: str, block: str):
    first, step = ({c: float(p[i]) for c, p in places.items()} for i in (0, 1))
    last = {c: p[3] for c, p in places.items()}
    return F.least(F.floor(_by_cell(first, cell) + _by_cell(step, cell) * F.col(block)).cast("int"), _by_cell(last, cell))


def _stats(df: DataFrame) -> dict[int, tuple[int, float]]:
    return {r.cell: (r.n, r.u) for r in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("u")).collect()}


def nearest_neighbours(queries: DataFrame, candidates: DataFrame, k: int, pivots: int | None = None, most_pivots: int = 1024) -> DataFrame:
    """(id, nid, dist, rank): the k nearest candidates of every query by Euclidean distance, excluding the same id.

    Both inputs have id BIGINT and vec ARRAY<DOUBLE>. Ties order by nid. The number of pivots follows the rows up to
    `most_pivots`, as the driver holds pivots x pivots distances; it changes the work and never the result.
    """
    if candidates.isEmpty() or queries.isEmpty():
        return queries.sparkSession.createDataFrame([], "id bigint, nid bigint, dist double, rank int")
    if pivots is None:
        pivots = int(min(most_pivots, max(4, math.isqrt(candidates.count()) // 4)))
    pv, centre = _pivots(candidates, pivots), _centre(candidates)
    cand, que = _assign(candidates, pv, centre), _assign(queries, pv, centre)
    cs, qs = _stats(cand), _stats(que)
    gap = np.sqrt(np.maximum(((pv[:, None] - pv[None]) ** 2).sum(-1), 0))
    links = []
    for i, (_, ui) in qs.items():
        reach, got, bound = sorted((ui + gap[i, j] + uj, n) for j, (n, uj) in cs.items()), 0, math.inf
        for d, n in reach:
            got += n
            if got >= k + 1:  # one of them may be the query itself
                bound = d
                break
        links += [(i, j) for j, (_, uj) in cs.items() if gap[i, j] - ui - uj <= bound + 1e-9 * (1 + bound + gap[i, j])]
    spark = queries.sparkSession
    # Tiles: candidate groups x query shards, both of bounded size and of neighbouring cells. A row is sent once for each tile
    # of its group or shard, not once for each cell it may meet.
    nc, nq = sum(n for n, _ in cs.values()), sum(n for n, _ in qs.values())
    groups, shards = _tiles(nc, nq, len(centre))
    order = _chain(gap)
    cplace, qplace = _places(cs, order, groups), _places(qs, order, shards)
    meet = sorted({(g, s) for i, j in links for g in range(cplace[j][2], cplace[j][3] + 1) for s in range(qplace[i][2], qplace[i][3] + 1)})
    tile = F.broadcast(spark.createDataFrame(meet, "grp int, shard int"))  # at most groups x shards rows
    linked = np.zeros(gap.shape, bool)
    linked[tuple(np.array(links).T)] = True
    apart = gap - np.array([qs.get(i, (0, 0.0))[1] for i in range(len(pv))])[:, None] - np.array([cs.get(j, (0, 0.0))[1] for j in range(len(pv))])[None]
    qb = _blocks(que, qs, ("qcell", "qblock", "qids", "qvec")).withColumn("shard", _part(qplace, "qcell", "qblock")).join(tile, "shard")
    cb = _blocks(cand, cs, ("ccell", "cblock", "cids", "cvec")).withColumn("grp", _part(cplace, "ccell", "cblock")).join(tile, "grp")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            cells = np.repeat(right["ccell"].to_numpy(), right["cids"].map(len).to_numpy())
            ci, c = np.concatenate(right["cids"].to_numpy()), np.concatenate(right["cvec"].to_numpy()).reshape(len(cells), -1)
            at = {int(j): np.flatnonzero(cells == j) for j in np.unique(cells)}
            for cell, qi, qv in zip(left["qcell"], left["qids"], left["qvec"]):
                near = sorted((max(0.0, apart[cell, j]), j) for j in at if linked[cell, j])
                if not near:
                    continue
                least = np.repeat([d for d, _ in near], [len(at[j]) for _, j in near])
                places = np.concatenate([at[j] for _, j in near])
                slabs = ((places[lo:lo + SLAB_ROWS], least[lo]) for lo in range(0, len(places), SLAB_ROWS))
                q = np.asarray(qv).reshape(len(qi), -1)
                row, nid, dist = _nearest_of(q, qi, c, ci, slabs, k, centre)
                parts.append(pd.DataFrame({"id": qi[row], "nid": nid, "dist": dist}))
        return pd.concat(parts) if parts else pd.DataFrame({"id": np.empty(0, np.int64), "nid": np.empty(0, np.int64), "dist": np.empty(0)})

    found = qb.select("grp", "shard", "qcell", "qids", "qvec").groupBy("grp", "shard").cogroup(
        cb.select("grp", "shard", "ccell", "cids", "cvec").groupBy("grp", "shard")).applyInPandas(best, "id bigint, nid bigint, dist double")
    w = W.partitionBy("id").orderBy("dist", "nid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lists_by_fold(queries: DataFrame, candidates: DataFrame, k: int, folds: int) -> DataFrame:
    """(id, nfold, nid, dist, rank): the k nearest candidates of each fold for every query. Candidates have a fold column.
    All folds together compare each query with each candidate at most once."""
    out = None
    for f in range(folds):
        part = nearest_neighbours(queries, candidates.where(F.col("fold") == f).select("id", "vec"), k).withColumn("nfold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def without_fold(lists: DataFrame, k: int, folds: int) -> DataFrame:
    """(id, without, nid, dist, rank): the k nearest of all candidates but those of fold `without`, for every fold."""
    x = lists.select("id", "nid", "dist", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("nfold"))).alias("without"))
    w = W.partitionBy("id", "without").orderBy("dist", "nid")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit_vectors(df: DataFrame) -> DataFrame:
    """L2-normalized vectors: Euclidean order equals cosine order, cosine distance = dist^2 / 2."""
    x = pin(df, "_n", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    return x.withColumn("vec", F.when(F.col("_n") > 0, F.transform("vec", lambda x: x / F.col("_n"))).otherwise(F.col("vec"))).drop("_n")


def cosine_graph(df: DataFrame, k: int) -> DataFrame:
    e = nearest_neighbours(unit_vectors(df), unit_vectors(df), k)
    return e.select(F.col("id").alias("src"), F.col("nid").alias("dst"), (F.col("dist") * F.col("dist") / 2).alias("dist"), "rank")


def column_scales(df: DataFrame) -> list[float]:
    """Population deviation of every dimension (one small row)."""
    x = df.select(F.posexplode("vec").alias("k", "v")).groupBy("k").agg(F.stddev_pop("v").alias("s")).collect()
    return [r.s if r.s and r.s > 0 else 1.0 for r in sorted(x, key=lambda r: r.k)]


def scaled(df: DataFrame, s: list[float]) -> DataFrame:
    return df.withColumn("vec", F.zip_with("vec", F.array(*[F.lit(float(v)) for v in s]), lambda a, b: a / b))


def knn_score_by_fold(df: DataFrame, n_folds: int, k: int) -> DataFrame:
    """Distance to the k-th neighbour among the other folds, in units of their deviations."""
    out = None
    for f in range(n_folds):
        train, val = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
        s = column_scales(train)
        e = nearest_neighbours(scaled(val, s).select("id", "vec"), scaled(train, s).select("id", "vec"), k)
        part = e.groupBy("id").agg(F.max("dist").alias("knn_dist")).withColumn("fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def local_outlier_factor(train_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """LOF of the sources of `edges` (their k neighbours in the training set); train_edges link the training set itself."""
    kd = train_edges.groupBy("id").agg(F.max("dist").alias("kdist"))

    def density(e):
        x = e.join(kd.withColumnRenamed("id", "nid"), "nid")
        return x.groupBy("id").agg((1.0 / (F.avg(F.greatest("dist", "kdist")) + 1e-10)).alias("lrd"))

    near = density(train_edges).withColumnsRenamed({"id": "nid", "lrd": "nlrd"})
    x = edges.join(near, "nid").groupBy("id").agg(F.avg("nlrd").alias("nlrd")).join(density(edges), "id")
    return x.select("id", (F.col("nlrd") / F.col("lrd")).alias("lof"))
