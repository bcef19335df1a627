"""Extremely randomised trees over binned rows, all trees of all folds grown together, one pass for each level.

A node draws some of the features its path has left open and for each one random cut between the bins the path allows. A
pass counts rows and positives left of every drawn cut; the driver then knows one best cut for each open node.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import cut_lineage
from .boosting import Tree, bin_edges, binned

FOUND = "fold int, tree int, node int, pick int, gain double, nl double, al double, n double, a double"


@dataclass(frozen=True)
class Forest:
    trees: int = 50
    depth: int = 8
    features: int | None = None  # drawn for each node; None: the square root of all
    least_rows: int = 2
    seed: int = 42


class Grower:
    """One tree of one fold on the driver: its nodes, and for each open node the box of bins and the cuts it drew."""

    def __init__(self, forest: Forest, fold: int, number: int, width: int, bins: int):
        self.forest, self.fold, self.number = forest, fold, number
        self.tree, self.level = Tree(), 0
        self.box = {0: (np.zeros(width, np.int64), np.full(width, bins - 1, np.int64))}
        self.open: list[int] = [0]
        self.drawn = {0: self._draw(0)}

    def _draw(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.box[node]
        left = np.flatnonzero(hi > lo)
        r = np.random.default_rng([self.forest.seed, self.fold, self.number, node])
        k = min(len(left), self.forest.features or max(1, int(np.sqrt(len(lo)))))
        pick = r.choice(left, k, replace=False) if k else left
        return pick, r.integers(lo[pick], hi[pick])

    def absorb(self, rows: list) -> None:
        opened = []
        for r in rows:
            node = r.node
            self.tree.value[node] = r.a / r.n if r.n else 0.5
            if r.gain <= 0 or self.level >= self.forest.depth:
                continue
            feature, cut = (int(x[r.pick]) for x in self.drawn[node])
            lo, hi = self.box.pop(node)
            for child, n, a, low, high in zip(self.tree.split(node, feature, cut), (r.nl, r.n - r.nl), (r.al, r.a - r.al), (lo[feature], cut + 1), (cut, hi[feature])):
                self.tree.value[child] = a / n
                if 0 < a < n and n >= 2 * self.forest.least_rows and self.level + 1 < self.forest.depth:
                    own = lo.copy(), hi.copy()
                    own[0][feature], own[1][feature] = low, high
                    self.box[child] = own
                    draw = self._draw(child)
                    if len(draw[0]):
                        self.drawn[child] = draw
                        opened.append(child)
        self.drawn = {k: v for k, v in self.drawn.items() if k in set(opened)}
        self.open, self.level = opened, self.level + 1


def _counts(jobs: list[dict], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, width)
            for job in jobs:
                train = fold != job["fold"]
                x, t = bins[train], y[train]
                place = np.full(len(job["tree"].feature), -1)
                place[job["open"]] = np.arange(len(job["open"]))
                slot = place[job["tree"].leaf(x)]
                x, t, slot = x[slot >= 0], t[slot >= 0], slot[slot >= 0]
                most = job["feature"].shape[1]
                left = x[np.arange(len(x))[:, None], job["feature"][slot]] <= job["cut"][slot]
                at = slot[:, None] * (most + 1) + np.arange(most)
                size = len(job["open"]) * (most + 1)
                sums = [np.bincount(np.r_[at[left], slot * (most + 1) + most], np.r_[np.repeat(w, most).reshape(-1, most)[left], w], size) for w in (np.ones(len(t)), t.astype(float))]
                key = job["fold"], job["number"]
                got[key] = got.get(key, 0) + np.stack(sums)
        for (f, k), x in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["fold", "tree", "sums"])

    return run


def _best(jobs: list[dict], least_rows: int):
    own = {(j["fold"], j["number"]): j for j in jobs}

    def run(table: pa.Table) -> pa.Table:
        f, k = table.column("fold")[0].as_py(), table.column("tree")[0].as_py()
        job = own[f, k]
        sums = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist()).reshape(2, len(job["open"]), -1)
        n, a = sums[0][:, -1:], sums[1][:, -1:]
        nl, al = sums[0][:, :-1], sums[1][:, :-1]
        spread = lambda n, a: a * (n - a) / np.maximum(n, 1)  # half the Gini impurity, by rows
        ok = (nl >= least_rows) & (n - nl >= least_rows) & (job["cut"] >= 0)
        gain = np.where(ok, spread(n, a) - spread(nl, al) - spread(n - nl, a - al), -1.0)
        pick = np.argmax(gain, axis=1)
        rows = np.arange(len(pick))
        return pa.table([pa.array(np.full(len(pick), f, np.int32)), pa.array(np.full(len(pick), k, np.int32)), pa.array(np.array(job["open"], np.int32)), pa.array(pick.astype(np.int32)),
                         *(pa.array(x) for x in (gain[rows, pick], nl[rows, pick], al[rows, pick], n[:, 0], a[:, 0]))], [x.split()[0] for x in FOUND.split(", ")])

    return run


def _job(g: Grower) -> dict:
    most = max(len(g.drawn[n][0]) for n in g.open)
    pad = lambda x, fill: np.r_[x, np.full(most - len(x), fill)].astype(np.int64)
    return {"fold": g.fold, "number": g.number, "tree": g.tree, "open": g.open, "feature": np.stack([pad(g.drawn[n][0], 0) for n in g.open]), "cut": np.stack([pad(g.drawn[n][1], -1) for n in g.open])}


def fit(df: DataFrame, forest: Forest, folds: int, edges: np.ndarray | None = None, id_col: str = "id", vec: str = "vec") -> tuple[DataFrame, list[Grower]]:
    """The binned rows, and all trees of all folds, each fitted without the rows of its fold. df: id, y, fold, vec."""
    edges = bin_edges(df, vec) if edges is None else edges
    width = edges.shape[0]
    rows = cut_lineage(binned(df, edges, vec, id_col))
    growers = [Grower(forest, f, k, width, edges.shape[1] + 1) for f in range(folds) for k in range(forest.trees)]
    while True:
        jobs = [_job(g) for g in growers if g.open]
        if not jobs:
            return rows, growers
        sums = rows.mapInArrow(_counts(jobs, width), "fold int, tree int, sums binary")
        by: dict[tuple[int, int], list] = {}
        for r in sums.groupBy("fold", "tree").applyInArrow(_best(jobs, forest.least_rows), FOUND).collect():  # one row for each open node
            by.setdefault((r.fold, r.tree), []).append(r)
        for g in growers:
            if g.open:
                g.absorb(sorted(by.get((g.fold, g.number), []), key=lambda r: r.node))


def out_of_fold(rows: DataFrame, growers: list[Grower]) -> DataFrame:
    """id, y, fold, p: the mean share of positives in the row's leaves, over the trees that left its fold out."""
    jobs: dict[int, list[Tree]] = {}
    for g in growers:
        jobs.setdefault(g.fold, []).append(g.tree)

    def run(batches):
        for batch in batches:
            fold = batch.column(2).to_numpy()
            bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            p = np.zeros(batch.num_rows)
            for own, trees in jobs.items():
                at = fold == own
                p[at] = np.mean([np.array(t.value)[t.leaf(bins[at])] for t in trees], axis=0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(p)], ["id", "y", "fold", "p"])

    return rows.mapInArrow(run, "id long, y double, fold int, p double")


def oof(df: DataFrame, forest: Forest = Forest(), folds: int = 5, **options) -> DataFrame:
    return out_of_fold(*fit(df, forest, folds, **options))
