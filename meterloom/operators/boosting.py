"""Gradient boosting for two classes over histograms, in three ways to grow a tree.

`leaf`: the leaf with the greatest gain is split next, up to a number of leaves. `level`: every leaf with a gain is split.
`symmetric`: one split for all leaves of a level, with ordered leaf estimates: a training row's own score uses only
rows of earlier segments of a hashed order, so it is not fitted to its own label.

Features are binned once. A pass over the binned rows serves all models of all folds and styles at once: each task adds its
rows' gradients to histograms, these are summed by (model, node, feature block) and the best split of each is found where
its sums meet; the driver sees one row for each node and block. Gradients are whole multiples of 2^-24, so the sums are
exact and the same in any order. Scores of finished trees are written every few rounds, which also cuts the lineage.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .folds import mixed

UNIT = float(1 << 24)
BLOCK = 64
LOSS, SEGMENTS = -1, -2
SUMS = "model int, node int, feature int, cut int, gain double, gl double, hl double, nl double, g double, h double, n double"


@dataclass(frozen=True)
class Style:
    """How a booster grows. `segments` above 1: ordered leaf estimates. Rounds stop when the loss on held-out training rows has
    not fallen for `patience` trees; the trees up to the least loss are kept. Labels may be soft, between 0 and 1."""

    growth: str = "leaf"
    rounds: int = 40
    rate: float = 0.1
    depth: int = 5
    leaves: int = 31
    l2: float = 1.0
    least_rows: int = 5
    least_gain: float = 1e-6
    segments: int = 1
    patience: int = 6
    columns: tuple[int, ...] | None = None  # features it may split on; None: all


STYLES = {"leaf_wise": Style("leaf", leaves=15), "level_wise": Style("level", depth=4), "symmetric": Style("symmetric", depth=4, segments=8)}


@dataclass
class Tree:
    """Nodes by number; feature -1 marks a leaf. A row goes left where its bin is at most the cut."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    steps: np.ndarray | None = None  # value of each node for rows of each segment

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        for own, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            own += [x, x]
        return a, a + 1

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = np.where(bins[rows, feature[at]] <= cut[at], left[at], right[at])
        return node


def gradients(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-score))
    return np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)


def best_splits(hist: np.ndarray, l2: float, least_rows: int, joint: bool) -> list[tuple]:
    """hist[node, feature, bin, (g, h, n)] -> for each node: feature, cut, gain, left sums (3), all sums (3)."""
    left = hist.cumsum(axis=2)
    whole = left[:, :1, -1:, :]
    left = left[:, :, :-1, :]
    right = whole - left
    value = lambda x: (x[..., 0] / UNIT) ** 2 / (x[..., 1] / UNIT + l2)
    gain = value(left) + value(right) - value(whole)
    if joint:
        total = gain.sum(axis=0)
        at = int(np.argmax(total))
        picks = [(at, float(total.flat[at]))] * len(hist)
    else:
        gain = np.where((left[..., 2] >= least_rows) & (right[..., 2] >= least_rows), gain, -np.inf)
        picks = [(int(np.argmax(x)), float(x.max())) for x in gain]
    out = []
    for k, (at, best) in enumerate(picks):
        f, c = divmod(at, hist.shape[2] - 1)
        out.append((f, c, best, *left[k, f, c], *whole[k, 0, 0]))
    return out


class Booster:
    """One model's trees and what it asks the next pass for; the driver's side, of a size set by the style alone."""

    def __init__(self, style: Style, fold: int, base: float):
        self.style, self.fold, self.base = style, fold, base
        self.trees: list[Tree] = []
        self.losses: list[float] = []
        self.done = False
        self._start()

    def _start(self) -> None:
        self.tree, self.open, self.level = Tree(), [0], 0
        self.gain: dict[int, float] = {}
        self.sums: dict[int, tuple] = {}
        self.ask = "split"

    @property
    def best(self) -> int:
        return int(np.argmin(self.losses)) if self.losses else 0

    def request(self) -> dict:
        return {"ask": self.ask, "tree": self.tree, "open": list(self.open), "loss": self.ask == "split" and self.level == 0 or self.ask == "loss"}

    def absorb(self, rows: list) -> None:
        for r in rows:
            if r["node"] == LOSS:
                self.losses.append(r["g"] / UNIT / max(r["n"], 1.0))
        n = len(self.losses)
        if self.ask == "loss" or n - 1 - self.best >= self.style.patience:
            self.done = True
        elif self.ask == "split":
            self._splits([r for r in rows if r["node"] >= 0])
        else:
            self._segments([r for r in rows if r["node"] >= 0])

    def _splits(self, rows: list) -> None:
        s, found = self.style, {}
        for r in sorted(rows, key=lambda r: (-r["gain"], r["feature"])):
            found.setdefault(r["node"], r)
        if s.growth == "symmetric":  # one split for the level: the best of the feature blocks
            top = min(rows, key=lambda r: (-r["gain"], r["feature"]))
            found = {r["node"]: r for r in rows if r["feature"] == top["feature"]}
        opened = []
        for node in self.open:
            r = found[node]
            self.sums[node] = (r["g"], r["h"])
            if r["gain"] > s.least_gain:
                self.gain[node] = r["gain"]
                a, b = self.tree.split(node, r["feature"], r["cut"])
                self.sums[a], self.sums[b] = (r["gl"], r["hl"]), (r["g"] - r["gl"], r["h"] - r["hl"])
                opened += [a, b]
        self.open, self.level = opened, self.level + 1
        if not opened or self.level >= s.depth:
            self._finish()

    def _finish(self) -> None:
        s, grown = self.style, self.tree
        if s.growth == "leaf":  # of the splits known, those that best-first growth takes
            tree, heap, leaves = Tree(), [], 1
            sums = {0: self.sums[0]}
            push = lambda own, old: old in self.gain and heapq.heappush(heap, (-self.gain[old], old, own))
            push(0, 0)
            while heap and leaves < s.leaves:
                _, old, own = heapq.heappop(heap)
                a, b = tree.split(own, grown.feature[old], grown.cut[old])
                leaves += 1
                for mine, theirs in ((a, grown.left[old]), (b, grown.right[old])):
                    sums[mine] = self.sums[theirs]
                    push(mine, theirs)
            self.tree, self.sums = tree, sums
        for node, (g, h) in self.sums.items():
            self.tree.value[node] = -s.rate * (g / UNIT) / (h / UNIT + s.l2)
        if s.segments > 1:
            self.ask = "segments"
        else:
            self._next()

    def _segments(self, rows: list) -> None:
        s = self.style
        sums = np.zeros((len(self.tree.feature), s.segments, 2))
        for r in rows:
            sums[r["node"], r["feature"]] = r["g"], r["h"]
        before = np.cumsum(sums, axis=1) - sums
        self.tree.steps = -s.rate * (before[..., 0] / UNIT) / (before[..., 1] / UNIT + s.l2)
        self._next()

    def _next(self) -> None:
        self.trees.append(self.tree)
        self._start()
        if len(self.trees) >= self.style.rounds:
            self.ask = "loss"


def _roles(ids: np.ndarray, fold: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Training rows of the model that leaves out fold `own`, and those of them that are held out for stopping."""
    train = fold != own
    held = train & ((ids * 7919 + 1000 + own) % 10007 % 10 == 0)
    return train & ~held, held


def _read(batch: pa.RecordBatch, width: int):
    col = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
    n = batch.num_rows
    bins = np.frombuffer(b"".join(col["bins"].to_pylist()), np.uint8).reshape(n, width) if n else np.empty((0, width), np.uint8)
    score = np.frombuffer(b"".join(col["score"].to_pylist()), np.float64).reshape(n, -1) if n else np.empty((0, 0))
    return col["id"].to_numpy(), col["y"].to_numpy(), col["fold"].to_numpy(), col["segment"].to_numpy(), bins, score.copy()


def _score(score: np.ndarray, trees: list[Tree], bins: np.ndarray, train: np.ndarray, segment: np.ndarray) -> None:
    """Adds the trees; training rows of an ordered model get the estimate of their segment."""
    for t in trees:
        leaf = t.leaf(bins)
        score += np.array(t.value)[leaf] if t.steps is None else np.where(train, t.steps[leaf, segment % t.steps.shape[1]], np.array(t.value)[leaf])


def _counted(jobs: dict[int, dict], width: int, cells: int):
    """Per task: histograms of the open nodes, sums of leaves by segment, and held-out losses of every model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int], tuple[list[int], np.ndarray]] = {}

        def add(model, part, nodes, x):
            known = got.setdefault((model, part), (nodes, np.zeros_like(x)))[1]
            np.add(known, x, out=known)

        for batch in batches:
            ids, y, fold, segment, bins, score = _read(batch, width)
            for m, job in jobs.items():
                train, held = _roles(ids, fold, job["fold"])
                f = score[:, m]
                _score(f, job["trees"], bins, train, segment)
                if job["loss"]:
                    z, t = f[held], y[held]
                    add(m, LOSS, [LOSS], np.array([np.rint((np.logaddexp(0, z) - t * z) * UNIT).sum(), 0.0, float(held.sum())]))
                if job["ask"] == "loss":
                    continue
                x = bins[train]
                g, h = gradients(f[train], y[train])
                node = job["tree"].leaf(x)
                if job["ask"] == "segments":
                    at = node * job["segments"] + segment[train] % job["segments"]
                    size = len(job["tree"].feature) * job["segments"]
                    add(m, SEGMENTS, [], np.stack([np.bincount(at, g, size), np.bincount(at, h, size)]))
                    continue
                place = np.full(len(job["tree"].feature), -1)
                place[job["open"]] = np.arange(len(job["open"]))
                slot = place[node]
                here = slot >= 0
                slot, x, g, h = slot[here], x[here], g[here], h[here]
                columns = np.arange(width) if job["columns"] is None else np.array(job["columns"])
                for block, lo in enumerate(range(0, len(columns), BLOCK)):
                    own = x[:, columns[lo:lo + BLOCK]]
                    k = own.shape[1]
                    at = ((slot[:, None] * k + np.arange(k)) * cells + own).ravel()
                    size = len(job["open"]) * k * cells
                    hist = np.stack([np.bincount(at, w, size) for w in (np.repeat(g, k), np.repeat(h, k), None)], axis=-1).reshape(len(job["open"]), k, cells, 3)
                    if job["joint"]:
                        add(m, block, job["open"], hist)
                    else:
                        for i, n in enumerate(job["open"]):
                            add(m, n * (1 << 12) + block, [n], hist[i:i + 1])
        for (m, part), (nodes, x) in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([part], pa.int64()), pa.array([nodes], pa.list_(pa.int32())), pa.array([x.astype(np.float64).tobytes()], pa.binary())], ["model", "part", "nodes", "sums"])

    return run


def _found(jobs: dict[int, dict], width: int, cells: int):
    """Sums of one model and node (or level) over all tasks, and its best split."""
    kinds = [pa.int32()] * 4 + [pa.float64()] * 7
    names = [x.split()[0] for x in SUMS.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        m, part = table.column("model")[0].as_py(), table.column("part")[0].as_py()
        nodes = table.column("nodes")[0].as_py()
        total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
        job = jobs[m]
        if part == LOSS:
            rows = [(m, LOSS, 0, 0, 0.0, 0.0, 0.0, 0.0, *total)]
        elif part == SEGMENTS:
            g, h = total.reshape(2, -1)
            rows = [(m, k // job["segments"], k % job["segments"], 0, 0.0, 0.0, 0.0, 0.0, g[k], h[k], 0.0) for k in np.flatnonzero((g != 0) | (h != 0)).tolist()]
        else:
            block = part % (1 << 12)
            hist = total.reshape(len(nodes), -1, cells, 3)
            column = lambda f: f if job["columns"] is None else job["columns"][f]
            rows = [(m, n, column(f + block * BLOCK), *rest) for n, (f, *rest) in zip(nodes, best_splits(hist, job["l2"], job["least_rows"], job["joint"]))]
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    return run


def bin_edges(df: DataFrame, vec: str = "vec", bins: int = 64) -> np.ndarray:
    """Upper edges of all bins but the last, for each feature; features x bins numbers. Labels are not looked at."""
    each = df.select(F.posexplode(vec).alias("f", "x")).where("x is not null and not isnan(x)")
    q = [i / bins for i in range(1, bins)]
    got = {r.f: r.q for r in each.groupBy("f").agg(F.percentile_approx("x", q, 20 * bins).alias("q")).collect()}
    width = df.select(F.max(F.size(vec))).first()[0] or 0
    return np.array([got.get(f, [0.0] * (bins - 1)) for f in range(width)], np.float64).reshape(width, bins - 1)


def binned(df: DataFrame, edges: np.ndarray, vec: str = "vec", id_col: str = "id") -> DataFrame:
    """id, y, fold, segment and the bins of each row, one byte for each feature; a missing value is in the last bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(3).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            b = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1).astype(np.uint8) if len(x) else x.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), batch.column(4), pa.array([r.tobytes() for r in b], pa.binary())], ["id", "y", "fold", "segment", "bins"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"), F.col(vec).cast("array<double>").alias("vec"), mixed(id_col, 77).cast("int").alias("segment"))
    return rows.mapInArrow(run, "id long, y double, fold int, segment int, bins binary")


def fit(df: DataFrame, styles: dict[str, Style], folds: int, edges: np.ndarray | None = None, refresh: int = 8, id_col: str = "id", vec: str = "vec") -> tuple[DataFrame, dict[tuple[str, int], Booster]]:
    """The binned rows and a fitted booster for each style and fold, which leaves that fold out. df: id, y, fold, vec."""
    edges = bin_edges(df, vec) if edges is None else edges
    width, cells = edges.shape[0], edges.shape[1] + 1
    base = {r.fold: (r.a, r.n) for r in df.groupBy("fold").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).collect()}
    models: list[Booster] = []
    for style in styles.values():
        for f in range(folds):
            a, n = (sum(v[k] for g, v in base.items() if g != f) for k in (0, 1))
            models.append(Booster(style, f, float(np.log((a + 0.5) / (n - a + 0.5)))))
    start = np.array([m.base for m in models], np.float64).tobytes()
    state = cut_lineage(binned(df, edges, vec, id_col).withColumn("score", F.lit(start)))
    applied = [0] * len(models)
    while not all(m.done for m in models):
        jobs = {k: {**m.request(), "fold": m.fold, "trees": m.trees[applied[k]:], "segments": m.style.segments, "joint": m.style.growth == "symmetric",
                    "columns": m.style.columns, "l2": m.style.l2, "least_rows": m.style.least_rows} for k, m in enumerate(models) if not m.done}
        sums = state.mapInArrow(_counted(jobs, width, cells), "model int, part long, nodes array<int>, sums binary")
        found = sums.groupBy("model", "part").applyInArrow(_found(jobs, width, cells), SUMS).collect()  # one row for each model, node and block
        by = {k: [] for k in jobs}
        for r in found:
            by[r.model].append(r)
        for k, rows in by.items():
            if any(r.node >= 0 for r in rows) or models[k].ask == "loss":
                models[k].absorb(rows)
            else:  # no row to train on
                models[k].done = True
        if max(len(m.trees) - a for m, a in zip(models, applied)) >= refresh:
            state = cut_lineage(_scored(state, models, applied, width))
            applied = [len(m.trees) for m in models]
    names = [(name, f) for name in styles for f in range(folds)]
    return state.drop("score"), dict(zip(names, models))


def _scored(state: DataFrame, models: list[Booster], applied: list[int], width: int) -> DataFrame:
    jobs = [(m.fold, m.trees[a:]) for m, a in zip(models, applied)]

    def run(batches):
        for batch in batches:
            ids, _, fold, segment, bins, score = _read(batch, width)
            for k, (own, trees) in enumerate(jobs):
                _score(score[:, k], trees, bins, _roles(ids, fold, own)[0], segment)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array([r.tobytes() for r in score], pa.binary())], batch.schema.names)

    return state.mapInArrow(run, state.schema)


def out_of_fold(rows: DataFrame, fitted: dict[tuple[str, int], Booster], leaves: int = 0) -> DataFrame:
    """id, y, fold, model, p: each row scored by the models that left its fold out. With `leaves`, also the leaf of the row
    in the first so many trees (-1 where there are fewer)."""
    jobs = [(name, f, m.base, m.trees[:m.best]) for (name, f), m in fitted.items()]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            raw = batch.column(4).to_pylist()
            bins = np.frombuffer(b"".join(raw), np.uint8).reshape(n, -1) if n else np.empty((0, 0), np.uint8)
            fold = batch.column(2).to_numpy()
            for name, own, base, trees in jobs:
                at = np.flatnonzero(fold == own)
                if not len(at):
                    continue
                score = np.full(len(at), base)
                _score(score, trees, bins[at], np.zeros(len(at), bool), np.zeros(len(at), np.int64))
                in_leaf = [t.leaf(bins[at]) for t in trees[:leaves]] + [np.full(len(at), -1)] * (leaves - len(trees[:leaves]))
                listed = pa.array(list(np.array(in_leaf, np.int32).reshape(leaves, len(at)).T), pa.list_(pa.int32())) if leaves else pa.array([[]] * len(at), pa.list_(pa.int32()))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), pa.array([name] * len(at)), pa.array(1.0 / (1.0 + np.exp(-score))), listed], ["id", "y", "fold", "model", "p", "leaves"])

    out = rows.mapInArrow(run, "id long, y double, fold int, model string, p double, leaves array<int>")
    return out if leaves else out.drop("leaves")


def oof(df: DataFrame, styles: dict[str, Style] | None = None, folds: int = 5, **options) -> DataFrame:
    """id, y, fold, model, p of boosters in the given styles, out of fold."""
    return out_of_fold(*fit(df, styles or STYLES, folds, **options))
