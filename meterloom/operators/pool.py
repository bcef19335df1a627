"""Operators on a pool of scores. Matrix form: id, y, p ARRAY<DOUBLE> with one entry per model (schema-bound width).

Candidates (blend weights) are evaluated many at a time: every task multiplies its rows with all weight vectors and
returns one threshold histogram per candidate, so a search step moves only (candidates x grid) rows per task.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import div, pin
from ..session import cut_lineage
from . import metrics as M
from .ranking import running_totals


# ---------------------------------------------------------------- Gram matrix


def gram(df: DataFrame, vec: str = "x") -> DataFrame:
    """Sum of outer products of an array column: (i <= j, s). One partial matrix per task, then a small sum."""

    def partial(batches):
        g = None
        for b in batches:
            if len(b):
                x = np.stack(b[vec].to_numpy())
                g = x.T @ x if g is None else g + x.T @ x
        if g is not None:
            i, j = np.triu_indices(len(g))
            yield pd.DataFrame({"i": i, "j": j, "s": g[i, j]})

    return df.select(vec).mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def gram_array(df: DataFrame, vec: str = "x") -> np.ndarray:
    rows = gram(df, vec).collect()  # (models + 2)^2 / 2 rows, bounded by the width of the pool
    k = max(r.j for r in rows) + 1
    g = np.zeros((k, k))
    for r in rows:
        g[r.i, r.j] = g[r.j, r.i] = r.s
    return g


def with_ones(m: DataFrame) -> DataFrame:
    return m.withColumn("x", F.concat(F.array(F.lit(1.0)), F.transform("p", lambda v: v.cast("double"))))


def pair_sums(m: DataFrame) -> DataFrame:
    """(a, b, sab, sa, sb, saa, sbb, n) for model pairs a < b from one Gram pass."""
    g = gram(with_ones(m))
    s = g.where("i = 0").select(F.col("j"), F.col("s").alias("s1"))
    d = g.where("i = j").select(F.col("j"), F.col("s").alias("s2"))
    v = s.join(d, "j")
    n = g.where("i = 0 and j = 0").select("s").scalar()
    pr = g.where("i > 0 and j > i")
    a = v.select(F.col("j").alias("i"), F.col("s1").alias("sa"), F.col("s2").alias("saa"))
    b = v.select("j", F.col("s1").alias("sb"), F.col("s2").alias("sbb"))
    return pr.join(a, "i").join(b, "j").select((F.col("i") - 1).alias("a"), (F.col("j") - 1).alias("b"), F.col("s").alias("sab"), "sa", "sb", "saa", "sbb", n.alias("n"))


def pearson_pairs(m: DataFrame) -> DataFrame:
    x = pair_sums(m)
    n = F.col("n")
    cov = n * F.col("sab") - F.col("sa") * F.col("sb")
    den = F.sqrt((n * F.col("saa") - F.col("sa") * F.col("sa")) * (n * F.col("sbb") - F.col("sb") * F.col("sb")))
    return x.select("a", "b", div(cov, den).alias("corr"))


def vote_pairs(m: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Q statistic and disagreement of votes, double-fault share of errors, for every pair."""
    v = m.withColumn("p", F.transform("p", lambda x: (x > threshold).cast("double")))
    e = m.withColumn("p", F.transform("p", lambda x: ((x > threshold).cast("int") != F.col("y")).cast("double")))
    x = pair_sums(v).withColumn("n10", F.col("saa") - F.col("sab")).withColumn("n01", F.col("sbb") - F.col("sab"))
    x = x.withColumn("n00", F.col("n") - F.col("saa") - F.col("sbb") + F.col("sab"))
    good, bad = F.col("sab") * F.col("n00"), F.col("n10") * F.col("n01")
    x = x.select("a", "b", div(good - bad, good + bad, 0).alias("q"), ((F.col("n10") + F.col("n01")) / F.col("n")).alias("disagreement"))
    return x.join(pair_sums(e).select("a", "b", (F.col("sab") / F.col("n")).alias("double_fault")), ["a", "b"])


def correlation_array(m: DataFrame) -> np.ndarray:
    g = gram_array(with_ones(m))
    n, s = g[0, 0], g[0, 1:]
    c = n * g[1:, 1:] - np.outer(s, s)
    d = np.sqrt(np.clip(np.diag(c), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = c / np.outer(d, d)
    return np.nan_to_num(r)


def diversity_summary(m: DataFrame, width: int, eig_threshold: float = 0.95) -> DataFrame:
    """Mean / largest pairwise correlation and effective rank (trace^2 / squared norm); eigenvalues above a level."""
    pr = pearson_pairs(m)
    c2 = F.coalesce(F.sum(F.col("corr") * F.col("corr")), F.lit(0.0))
    eig = np.linalg.eigvalsh(correlation_array(m))
    return pr.agg(F.avg("corr").alias("mean_corr"), F.max("corr").alias("max_corr"), (float(width * width) / (width + 2 * c2)).alias("effective_rank")) \
        .withColumn("n_eigen", F.lit(int((np.clip(eig, 1e-12, None) > eig_threshold).sum())))


def prune_in_order(corr: np.ndarray, order: list[int], limit: float, strict: bool = True) -> list[int]:
    """Keep an item unless it correlates above the limit with one kept before."""
    kept: list[int] = []
    for k in order:
        top = max((abs(corr[k, j]) for j in kept), default=0.0)
        if top <= limit if strict else top < limit:
            kept.append(k)
    return kept


def prune_by_clusters(corr: np.ndarray, limit: float, quality: np.ndarray) -> list[int]:
    """Average-link clusters, as few as keep every within-cluster correlation below the limit; best member of each."""
    c = np.abs(corr)
    dist = 1 - c
    parts = [[k] for k in range(len(c))]
    history = {len(parts): [list(p) for p in parts]}
    while len(parts) > 1:
        best = min(((dist[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j))
        _, i, j = best
        parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [parts[i] + parts[j]]
        history[len(parts)] = [list(p) for p in parts]

    def tight(p):
        return all(len(g) < 2 or c[np.ix_(g, g)][np.triu_indices(len(g), 1)].max() < limit for g in p)

    k = next((k for k in range(2, len(c) + 1) if tight(history[k])), 1)
    return sorted(max(g, key=lambda i: (quality[i], -i)) for g in history[k])


# ---------------------------------------------------------------- candidate evaluation


def candidate_histogram(m: DataFrame, weights: np.ndarray, grid: M.Grid = M.GRID, by: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """(by, cand, b, pos, neg): threshold histogram of every weighted blend, summed inside each task first."""
    by = list(by or [])
    th = M.grid_values(grid)
    k = len(th) + 1
    wt = np.asarray(weights, float)
    side = "right" if inclusive else "left"

    def count(batches):
        acc: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            for key, part in (b.groupby(by) if by else [((), b)]):
                every = np.stack(part["p"].to_numpy())
                y = part["y"].to_numpy().astype(bool)
                h = acc.setdefault(tuple(key), np.zeros((2, len(wt) * k), np.int64))
                for c in range(0, len(wt), 256):  # a bounded block of rows x candidates
                    some = wt[c:c + 256]
                    cell = np.searchsorted(th, every @ some.T, side=side) + np.arange(len(some)) * k
                    at = slice(c * k, (c + len(some)) * k)
                    h[0, at] += np.bincount(cell[y].ravel(), minlength=len(some) * k)
                    h[1, at] += np.bincount(cell[~y].ravel(), minlength=len(some) * k)
        for key, h in acc.items():
            at = np.flatnonzero(h.sum(axis=0))
            out = {c: v for c, v in zip(by, key)}
            yield pd.DataFrame({**{c: np.repeat(v, len(at)) for c, v in out.items()}, "cand": at // k, "b": at % k, "pos": h[0, at], "neg": h[1, at]})

    types = {f.name: f.dataType.simpleString() for f in m.schema.fields}
    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["cand int", "b int", "pos bigint", "neg bigint"])
    return m.select(*by, "y", "p").mapInPandas(count, schema).groupBy(*by, "cand", "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def evaluate_weights(m: DataFrame, weights, grid: M.Grid = M.GRID, by: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """Best F1 (with threshold, recall, precision) of every candidate weight vector, in one job."""
    by = list(by or [])
    h = candidate_histogram(m, np.asarray(weights, float), grid, by, inclusive)
    t = M.with_rates(M.table_from_histogram(h, by + ["cand"], grid))
    return M.first_best(t, by + ["cand"], "f1", ["f1", "recall", "precision"], (F.col("tp") + F.col("fp")) > 0)


def f1_of_weights(m: DataFrame, weights, grid: M.Grid = M.GRID) -> np.ndarray:
    rows = evaluate_weights(m, weights, grid).select("cand", "f1").collect()  # one row per candidate
    out = np.zeros(len(weights))
    for r in rows:
        out[r.cand] = r.f1
    return out


def unit(k: int, members: list[int]) -> np.ndarray:
    w = np.zeros(k)
    w[members] = 1.0 / len(members)
    return w


def greedy_forward(m: DataFrame, width: int, max_size: int = 15, n_candidates: int | None = None) -> list[tuple[int, int, float]]:
    """Grow an equal-weight ensemble by the candidate that raises F1 most; one job per step. [(step, model, f1)]

    n_candidates: try only so many of the best remaining models at each step; None tries all."""
    single = f1_of_weights(m, np.eye(width))
    order = sorted(range(width), key=lambda i: -single[i])
    chosen, best = [order[0]], float(single[order[0]])
    trace = [(1, order[0], best)]
    while len(chosen) < min(max_size, width):
        cands = [i for i in order if i not in chosen][:n_candidates]
        f1 = f1_of_weights(m, [unit(width, chosen + [c]) for c in cands])
        k = int(f1.argmax())
        if f1[k] <= best:
            break
        chosen, best = chosen + [cands[k]], float(f1[k])
        trace.append((len(chosen), cands[k], best))
    return trace


def greedy_diverse(m: DataFrame, width: int, n_select: int, diversity_weight: float = 0.5, grid: M.Grid = (50, 950, 50)) -> list[tuple[int, int, float]]:
    """Forward selection on (1-d) * F1 + d * (1 - mean pairwise correlation)."""
    corr = correlation_array(m)
    chosen, trace = [], []
    while len(chosen) < min(n_select, width):
        cands = [i for i in range(width) if i not in chosen]
        f1 = f1_of_weights(m, [unit(width, chosen + [c]) for c in cands], grid)

        def diversity(c):
            s = chosen + [c]
            return 1 - corr[np.ix_(s, s)][np.triu_indices(len(s), 1)].mean() if len(s) > 1 else 1.0

        obj = [(1 - diversity_weight) * f + diversity_weight * diversity(c) for f, c in zip(f1, cands)]
        k = int(np.argmax(obj))
        chosen.append(cands[k])
        trace.append((len(chosen), cands[k], float(obj[k])))
    return trace


def nnls_from_gram(a: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Non-negative least squares from P'P and P'y by an active set; sizes are pool width, the rows stay in Spark."""
    k = len(b)
    w, free = np.zeros(k), np.zeros(k, bool)
    for _ in range(3 * k):
        grad = b - a @ w
        if free.all() or grad[~free].max(initial=-np.inf) <= tol:
            break
        free[np.where(~free, grad, -np.inf).argmax()] = True
        while True:
            z = np.zeros(k)
            z[free] = np.linalg.lstsq(a[np.ix_(free, free)], b[free], rcond=None)[0]
            neg = free & (z <= 0)
            if not neg.any():
                w = z
                break
            step = (w[neg] / np.maximum(w[neg] - z[neg], 1e-300)).min()
            w = w + step * (z - w)
            free &= w > 1e-12
            w[~free] = 0
    return w


def nnls_weights(m: DataFrame) -> np.ndarray:
    """Normalized non-negative weights fitted to the labels (uniform if all are zero)."""
    g = gram_array(m.withColumn("x", F.concat(F.array(F.col("y").cast("double")), "p")))
    w = nnls_from_gram(g[1:, 1:], g[0, 1:])
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def coordinate_grid(m: DataFrame, width: int, levels: int = 11, passes: int = 3) -> tuple[np.ndarray, float]:
    """Try `levels` values for one weight at a time (renormalized), weight after weight; an improvement is kept at once.

    All trials of a pass that are still ahead share one job; after an improvement the rest start from the new weights."""
    best = np.full(width, 1 / width)
    top = float(f1_of_weights(m, [best])[0])
    order = [(i, v) for i in range(width) for v in np.linspace(0, 1, levels)]
    for _ in range(passes):
        at, improved = 0, False
        while at < len(order):
            trial = np.repeat(best[None], len(order) - at, axis=0)
            trial[np.arange(len(trial)), [i for i, _ in order[at:]]] = [v for _, v in order[at:]]
            total = trial.sum(axis=1, keepdims=True)
            trial = trial / np.where(total > 0, total, 1)
            f1 = f1_of_weights(m, trial)
            up = np.flatnonzero(f1 > top)
            if not up.size:
                break
            best, top, improved, at = trial[up[0]], float(f1[up[0]]), True, at + int(up[0]) + 1
        if not improved:
            break
    return best, top


def hill_climb(m: DataFrame, width: int, step: float = 0.1, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Move one weight by +-step while F1 rises; the 2 x width neighbours of a round share one job."""
    best = np.full(width, 1 / width)
    top = float(f1_of_weights(m, [best])[0])
    for _ in range(rounds):
        trial = []
        for i in range(width):
            for s in (step, -step):
                w = best.copy()
                w[i] = max(0.0, w[i] + s)
                if w.sum() > 0:
                    trial.append(w / w.sum())
        f1 = f1_of_weights(m, trial)
        k = int(f1.argmax())
        if f1[k] <= top:
            break
        best, top = trial[k], float(f1[k])
    return best, top


#: Scores of blends are whole multiples of 1 / ONE.
ONE = 10 ** 12
#: Cells are split until at most LEFT rows are left in them, or as many cells as make CELLS parts of 16 at least.
LEFT, CELLS = 2_000_000, 1 << 27
#: A task takes a tile of so many bytes of rows and of at least BLOCK blends.
TILE_BYTES, BLOCK = 8 << 20, 250


def _blend_keys(every: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """blends x rows of scores, times ONE; added up model by model, so that a score is the same number in every pass."""
    s = weights[:, :1] * every[:, 0]
    for j in range(1, every.shape[1]):
        s += weights[:, j:j + 1] * every[:, j]
    return np.rint(s * ONE).astype(np.int64)


def _tiles(m: DataFrame, weights: np.ndarray, look, schema: str, start=None) -> DataFrame:
    """Rows that look(first blend, keys of some blends x some rows, y, state of the tile) yields for every tile of rows and blends,
    and look(None, None, None, state) at its end; start(block's slice) makes the state. A y of 2 stands for null."""
    blocks = max(1, min(32, len(weights) // BLOCK))
    edge = np.linspace(0, len(weights), blocks + 1).astype(int)
    groups = max(1, -(-m.count() * weights.shape[1] * 8 // TILE_BYTES))

    def pack(batches):
        for k, b in enumerate(batches):
            if len(b):
                p = np.stack(b["p"].to_numpy()).astype(float)
                yield pd.DataFrame({"k": [k], "p": [p.tobytes()], "y": [(b["y"].to_numpy().astype(bool) + b["y"].isna().to_numpy().astype(np.int8)).tobytes()]})

    def run(batches):
        states: dict[int, object] = {}
        for batch in batches:
            for block, p, y in zip(batch["block"], batch["p"], batch["y"]):
                a, z = edge[block], edge[block + 1]
                if block not in states:
                    states[block] = start(a, z) if start else None
                y = np.frombuffer(y, np.int8)
                every = np.frombuffer(p, float).reshape(len(y), -1)
                for c in range(a, z, 64):  # a bounded block of blends x rows
                    yield from look(c, _blend_keys(every, weights[c:min(c + 64, z)]), y, states[block])
        for state in states.values():
            yield from look(None, None, None, state)

    packed = m.select("y", "p").mapInPandas(pack, "k long, p binary, y binary").withColumn("group", F.pmod(F.col("k") + F.spark_partition_id(), F.lit(groups)))
    spread = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks * groups, "block", "group")
    return spread.select("block", "p", "y").mapInPandas(run, schema)


def _counted(part: DataFrame, *by: str) -> DataFrame:
    return part.groupBy("cand", *by, "lo").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _blend_cells(m: DataFrame, weights: np.ndarray, cells: int) -> DataFrame:
    """cand, lo, pos, neg: rows of every blend by cell, from the score lo / ONE on, summed inside each tile first."""
    wide = -(-ONE // cells)

    def start(a, z):
        return a, np.zeros((z - a) * (cells + 1) * 2, np.int64)

    def look(c, keys, y, state):
        first, h = state
        if c is None:
            n = h.reshape(-1, 2)
            at = np.flatnonzero(n.any(axis=1))
            yield pd.DataFrame({"cand": (first + at // (cells + 1)).astype(np.int32), "lo": at % (cells + 1) * wide, "pos": n[at, 1], "neg": n[at, 0]})
            return
        cell = np.clip(keys // wide, 0, cells) + np.arange(len(keys))[:, None] * (cells + 1)
        a = (c - first) * (cells + 1) * 2
        n = len(keys) * (cells + 1) * 2
        h[a:a + n] += np.bincount((cell * 2 + (y > 0)).ravel(), minlength=n)

    return _counted(_tiles(m, weights, look, "cand int, lo long, pos long, neg long", start))


def _inside(keys: np.ndarray, y: np.ndarray, lo: np.ndarray, wide: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled rows of one blend inside its cells of one width (sorted by lo), and the cell of each."""
    k = np.clip(keys, 0, top)
    i = np.searchsorted(lo, k, "right") - 1
    at = np.flatnonzero((i >= 0) & (k < lo[i] + wide) & (y < 2))
    return at, i[at]


def _cells_of(live: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each blend's cells begin among all, and their lo: at most CELLS / 16 cells."""
    t = live.select("cand", "lo").toArrow()
    cand, lo = t["cand"].to_numpy(), t["lo"].to_numpy()
    order = np.lexsort((lo, cand))
    return np.searchsorted(cand[order], np.arange(n + 1)), lo[order]


def _split(m: DataFrame, weights: np.ndarray, live: DataFrame, wide: int, top: int, parts: int) -> DataFrame:
    """cand, from, lo, pos, neg: rows by the parts, from lo on, of the live cells, from `from` on."""
    at, los = _cells_of(live, len(weights))
    step = -(-wide // parts)

    def start(a, z):
        return a, z, np.zeros((at[z] - at[a]) * parts * 2, np.int64)

    def look(c, keys, y, state):
        first, last, h = state
        if c is None:
            n = h.reshape(-1, 2)
            k = np.flatnonzero(n.any(axis=1))
            cell = at[first] + k // parts
            yield pd.DataFrame({"cand": (np.searchsorted(at, cell, "right") - 1).astype(np.int32), "from": los[cell], "lo": los[cell] + k % parts * step, "pos": n[k, 1], "neg": n[k, 0]})
            return
        for b, own in enumerate(keys, c):
            if at[b] < at[b + 1]:
                lo = los[at[b]:at[b + 1]]
                rows, i = _inside(own, y, lo, wide, top)
                part = (np.clip(own[rows], 0, top) - lo[i]) // step
                n = len(lo) * parts * 2
                a = (at[b] - at[first]) * parts * 2
                h[a:a + n] += np.bincount((i * parts + part) * 2 + y[rows], minlength=n)

    return _counted(_tiles(m, weights, look, "cand int, from long, lo long, pos long, neg long", start), "from")


def _exact_points(m: DataFrame, weights: np.ndarray, live: DataFrame, wide: int, top: int) -> DataFrame:
    """cand, front, threshold, tp, fp at every distinct score inside the live cells of one width."""
    at, los = _cells_of(live, len(weights))

    def look(c, keys, y, _):
        if c is not None:
            for b, own in enumerate(keys, c):
                if at[b] < at[b + 1]:
                    lo = los[at[b]:at[b + 1]]
                    rows, i = _inside(own, y, lo, wide, top)
                    if len(rows):
                        yield pd.DataFrame({"cand": np.full(len(rows), b, np.int32), "lo": lo[i], "p": own[rows], "y": y[rows].astype(np.int64)})

    rows = _tiles(m, weights, look, "cand int, lo long, p long, y long")
    t = running_totals(rows, "p", {"pos": F.col("y"), "neg": 1 - F.col("y")}, by=["cand", "lo"], descending=True, buckets=16)
    above = live.select("cand", "lo", "front", "tp_above", "fp_above")
    return t.join(above, ["cand", "lo"]).select("cand", "front", (F.col("key") / float(ONE)).alias("threshold"), (F.col("tp_above") + F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("fp_above") + F.col("neg_before") + F.col("neg")).alias("fp"))


EPS = 1e-12


def _bounded(x: DataFrame) -> DataFrame:
    """Cells with what is certain at their least score (known, high) and the most that a threshold inside can reach."""
    tp, fp = F.col("tp_above") + F.col("pos"), F.col("fp_above") + F.col("neg")
    return x.withColumns({"known": tp * 2 / (tp + fp + F.col("all")), "most": tp * 2 / (tp + F.col("fp_above") + F.col("all")),
                          "low": F.col("tp_above") / F.col("all"), "high": tp / F.col("all")})


def _may_be_best(x: DataFrame) -> DataFrame:
    return _bounded(x).where(F.col("most") >= x.transform(_bounded).agg(F.max("known")).scalar() - EPS).select(x.columns)


def _bin_of(c: str, width: float) -> Column:
    return F.floor(F.col(c) / width + 1e-9)


def _may_be_seen(x: DataFrame, floor: float, width: float) -> DataFrame:
    """Cells that may hold the best of a blend that may win a bin of recall (front), or the best with recall of `floor`."""
    b = _bounded(x)
    b = b.withColumn("own", F.max(F.when(F.col("front"), F.col("known"))).over(W.partitionBy("cand"))).withColumn("front", F.col("front") & (F.col("most") >= F.col("own") - EPS))
    reach = b.where("front").groupBy("cand", "own").agg(F.max("most").alias("most"), F.min(_bin_of("low", width)).alias("from"), F.max(_bin_of("high", width)).alias("to"))
    sure = reach.where("from = to").groupBy(F.col("to").alias("bin")).agg(F.max("own").alias("sure"))
    spans = reach.select("cand", "most", F.explode(F.sequence("from", "to")).alias("bin")).join(F.broadcast(sure), "bin", "left")  # a row for each bin of recall
    win = spans.where(F.col("most") >= F.coalesce("sure", F.lit(0.0)) - EPS).select("cand", F.lit(True).alias("win")).distinct()
    reached = x.transform(_bounded).where(F.col("high") >= floor).agg(F.max("known").alias("least")).scalar()
    b = b.join(win, "cand", "left").withColumn("front", F.col("front") & F.coalesce("win", F.lit(False)))
    return b.where(F.col("front") | (F.col("high") >= floor - EPS) & (F.col("most") >= reached - EPS)).select(x.columns)


def exact_blends(m: DataFrame, weights: np.ndarray, floor: float = 0.9, width: float = 0.05, cells: int = 200, best_only: bool = False) -> DataFrame:
    """kind, recall_bin, f1, recall, precision, cand, threshold: over every distinct score of every blend, exact.

    `frontier`: each blend's best F1, and of these the best for each bin of recall; `floor`: the best F1 of any blend and
    threshold with recall of at least `floor`; `best`: the best F1 of all. Of equal ones the first blend counts, and of its
    thresholds the greatest. Scores at or above a threshold are positive.

    Branch and bound: counts by cell of the score bound the F1 and the recall of all thresholds inside a cell. A cell below its
    blend's own bound, and a blend below what is certain in every bin it may fall in, are dropped; cells left are split and
    counted anew until few rows are in them, and only these are looked at one by one. Equal scores end in a cell of their own.
    A null y counts as positive above a cell of the first pass, and not at all inside. With `best_only` all cells below the best bound of all blends go, and only `best` is returned.
    """
    wt = np.asarray(weights, float)
    wide = -(-ONE // cells)
    top = wide * (cells + 1) - 1
    rule = _may_be_best if best_only else lambda x: _may_be_seen(x, floor, width)

    def totalled(h: DataFrame, by: list[str]) -> DataFrame:
        w = W.partitionBy(*by).orderBy(F.desc("lo")).rowsBetween(W.unboundedPreceding, 0)
        return h.withColumns({"tp_above": F.sum("pos").over(w) - F.col("pos"), "fp_above": F.sum("neg").over(w) - F.col("neg")})

    x = totalled(_blend_cells(m, wt, cells), ["cand"]).withColumns({"all": F.sum("pos").over(W.partitionBy("cand")), "front": F.lit(True), "wide": F.lit(wide)})
    x = cut_lineage(x.where("pos > 0"))
    one = (F.col("wide") == 1) & (F.col("lo") > 0) & (F.col("lo") < top)  # a single score; those outside of 0 to 1 are in the cells of its ends
    while True:
        x = cut_lineage(rule(x))
        live = x.where(~one)
        left = live.agg(F.count("*").alias("n"), F.sum(F.col("pos") + F.col("neg")).alias("rows")).first()
        if wide == 1 or not left.n or left.rows <= LEFT or left.n * 16 > CELLS or left.n * 2 > left.rows:
            break
        parts = min(wide, 1000, max(16, (1 << 23) // left.n))
        step = -(-wide // parts)
        old = live.select("cand", F.col("lo").alias("from"), F.col("tp_above").alias("tp0"), F.col("fp_above").alias("fp0"), "all", "front")
        new = totalled(_split(m, wt, live, wide, top, parts), ["cand", "from"]).join(old, ["cand", "from"])
        new = new.withColumns({"tp_above": F.col("tp_above") + F.col("tp0"), "fp_above": F.col("fp_above") + F.col("fp0"), "wide": F.lit(step)})
        x, wide = cut_lineage(x.where(one).unionByName(new.where("pos > 0").select(x.columns))), step
    p = x.where(one).select("cand", "front", (F.col("lo") / float(ONE)).alias("threshold"), (F.col("tp_above") + F.col("pos")).alias("tp"), (F.col("fp_above") + F.col("neg")).alias("fp"))
    if left.n:
        p = p.unionByName(_exact_points(m, wt, live, wide, top))
    p = p.withColumn("n", x.select(F.max("all").alias("n")).scalar())
    p = cut_lineage(p.select("cand", "front", "threshold", (F.col("tp") * 2 / (F.col("tp") + F.col("fp") + F.col("n"))).alias("f1"), (F.col("tp") / F.col("n")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision")).where("recall > 0"))
    point, first = F.struct("f1", "recall", "precision", "cand", "threshold"), F.struct(F.round("f1", 12), -F.col("cand"), F.col("threshold"))
    none = F.lit(None).cast("double").alias("recall_bin")
    if best_only:
        return p.agg(F.max_by(point, first).alias("b")).where("b is not null").select(F.lit("best").alias("kind"), none, "b.*")
    tops = p.where("front").groupBy("cand").agg(F.max_by(point, first).alias("b")).select("b.*").withColumn("recall_bin", _bin_of("recall", width) * width)
    bins = tops.groupBy("recall_bin").agg(F.max_by(point, first).alias("b")).select(F.lit("frontier").alias("kind"), "recall_bin", "b.*")
    held = p.where(F.col("recall") >= floor).agg(F.max_by(point, first).alias("b")).where("b is not null").select(F.lit("floor").alias("kind"), none, "b.*")
    best = tops.agg(F.max_by(point, first).alias("b")).where("b is not null").select(F.lit("best").alias("kind"), none, "b.*")
    return bins.unionByName(held).unionByName(best)


# ---------------------------------------------------------------- votes and labels


def votes(threshold: float = 0.5) -> Column:
    return F.size(F.filter("p", lambda x: x > threshold))


def consensus_labels(m: DataFrame, width: int, threshold: float = 0.5, needed: int | None = None) -> DataFrame:
    need = needed if needed is not None else width // 2 + 1
    x = m.withColumn("n_votes", votes(threshold)).withColumn("clean", (F.col("n_votes") >= need).cast("int"))
    return x.select("id", "y", "n_votes", "clean", (F.col("clean") != F.col("y")).alias("issue"))


def leave_one_out_consensus(m: DataFrame, width: int, threshold: float = 0.5) -> DataFrame:
    """Consensus without each model in turn = all votes minus its own; final label by their majority."""
    need = (width - 1) // 2 + 1
    x = pin(m, "n_votes", votes(threshold))
    loo = F.transform("p", lambda v: (F.col("n_votes") - (v > threshold).cast("int") >= need).cast("int"))
    x = x.withColumn("loo", loo)
    share = F.aggregate("loo", F.lit(0), lambda a, v: a + v) / float(width)
    return x.select("id", "y", "loo", (share >= 0.5).cast("int").alias("final"), ((share >= 0.5).cast("int") != F.col("y")).alias("disagree"))


def noise_by_class(issues: DataFrame) -> DataFrame:
    return issues.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("issue").cast("double")).alias("noise_rate"))


def confident_learning(scored: DataFrame, min_examples: int = 1) -> DataFrame:
    """id, y, issue by class thresholds, confident joint and pruning by noise rate (two classes).

    A row counts for the class whose probability reaches that class's mean self-confidence (the larger one if both);
    per given class the estimated number of wrong labels with the largest margins is flagged.
    """
    p1, y = F.col("p"), F.col("y")
    self_p = F.when(y == 1, p1).otherwise(1 - p1)
    th = scored.agg(F.struct(F.avg(F.when(y == 0, 1 - p1)).alias("t0"), F.avg(F.when(y == 1, p1)).alias("t1")).alias("t")).scalar()
    x = scored.withColumn("_t", th)
    in0, in1 = (1 - p1) >= F.col("_t.t0") - 1e-6, p1 >= F.col("_t.t1") - 1e-6
    guess = F.when(in0 & in1, (p1 > 0.5).cast("int")).when(in0, 0).when(in1, 1)
    x = x.withColumn("guess", guess)
    joint = x.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("guess").isNotNull()).alias("counted"), F.count_if(F.col("guess") == 1 - F.col("y")).alias("off"))
    quota = joint.select("y", F.least(F.round(div(F.col("off") * F.col("n"), F.col("counted"), 0)), F.col("n") - min_examples).cast("bigint").alias("quota"))
    margin = F.struct((self_p - (1 - self_p)).alias("m"), F.col("id").alias("i"))  # ascending: most doubtful first
    r = running_totals(scored, margin, {"c": F.lit(1)}, by=["y"], collapsed=True)
    return r.join(F.broadcast(quota), "y").select(F.col("key.i").alias("id"), "y", ((F.col("c_before") < F.col("quota")) & (F.col("key.m") < 0)).alias("issue"))


def small_loss(df: DataFrame, keep_by: str, forget: float, id_col: str = "id") -> DataFrame:
    """Rows whose log-loss under the other model is among the smallest 1 - forget."""
    y, p = F.col("y"), F.col(keep_by)
    loss = -(y * F.log(F.greatest(p, F.lit(1e-7))) + (1 - y) * F.log(F.greatest(1 - p, F.lit(1e-7))))
    r = running_totals(df, F.struct(loss.alias("l"), F.col(id_col).alias("i")), {"c": F.lit(1)}, collapsed=True)
    return r.select(F.col("key.i").alias(id_col), F.col("key.l").alias("loss"), (F.col("c_before") < F.floor((1 - forget) * F.col("c_all") + 1e-9)).alias("keep"))


def forget_rate(epoch: int, max_epoch: int, initial: float = 0.0, final: float = 0.3, warmup: int = 10) -> float:
    if epoch < warmup:
        return initial
    return initial + (final - initial) * min((epoch - warmup) / max(max_epoch - warmup, 1), 1.0)


def flip_labels(voted: DataFrame, score: str, lo: float, hi: float) -> DataFrame:
    """Labels contradicted by a vote share or mean score beyond the two limits are flipped."""
    s, y = F.col(score), F.col("y")
    down, up = (y == 1) & (s < lo), (y == 0) & (s > hi)
    return voted.withColumn("flip_down", down).withColumn("flip_up", up).withColumn("clean", F.when(down, 0).when(up, 1).otherwise(y))


def voter_shares(scores: DataFrame, min_auc: float, min_voters: int = 3) -> DataFrame:
    """Vote share and mean score per id over the models whose AUC reaches the floor; fails with too few of them."""
    ok = M.roc_auc(scores, ["model"]).where(F.col("auc") >= min_auc).select("model")
    g = scores.join(ok, "model", "left_semi").groupBy("id", "y").agg(F.count(F.lit(1)).alias("voters"), F.avg((F.col("p") > 0.5).cast("double")).alias("vote_share"), F.avg("p").alias("mean_p"))
    enough = F.when(F.col("voters") >= min_voters, F.col("voters")).otherwise(F.raise_error(F.lit("too few voters")))
    return g.withColumn("voters", enough.cast("bigint"))


# ---------------------------------------------------------------- rules on two scores


def rule_grid(df: DataFrame, p: str, gap: str, level: str, ths: list[float], gaps: list[float], levels: list[float]) -> DataFrame:
    """Rescue / filter rules (score passes th; share > gap and level < limit turn the decision) over the full grid.

    Rescued rows are negatives and filtered rows positives, so counts split into two independent tables built from one
    three-dimensional histogram; the rows are read once, whatever the size of the grid.
    """
    def below(c, vals):  # number of grid values the column exceeds
        return sum(((F.col(c) > float(v)).cast("int") for v in vals), F.lit(0))

    def under(c, vals):  # number of grid values not above the column: the limit must lie beyond them
        return sum(((F.col(c) >= float(v)).cast("int") for v in vals), F.lit(0))

    h = df.groupBy(below(p, ths).alias("bp"), below(gap, gaps).alias("bg"), under(level, levels).alias("bl")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    cells = [(i, float(t), j, float(g), k, float(v)) for i, t in enumerate(ths) for j, g in enumerate(gaps) for k, v in enumerate(levels)]
    x = df.sparkSession.createDataFrame(cells, "ti int, th double, gi int, gap double, li int, level double").withColumn("h", packed(h))
    up = lambda c: c["bp"] > F.col("ti")
    hit = lambda c: (c["bg"] > F.col("gi")) & (c["bl"] <= F.col("li"))
    moved = x.select("ti", "gap", "level", *[cell_sum(lambda c: hit(c) & ~up(c), k).alias(f"in_{k}") for k in ("pos", "neg")],
                     *[cell_sum(lambda c: hit(c) & up(c), k).alias(f"out_{k}") for k in ("pos", "neg")])
    base = x.where("gi = 0 and li = 0").select("ti", "th", cell_sum(up, "pos").alias("tp"), cell_sum(up, "neg").alias("fp"), cell_sum(lambda c: F.lit(True), "pos").alias("n_pos"))
    r = moved.select("ti", F.col("gap").alias("gap_in"), F.col("level").alias("level_in"), "in_pos", "in_neg")
    f = moved.select("ti", F.col("gap").alias("gap_out"), F.col("level").alias("level_out"), "out_pos", "out_neg")
    x = base.join(r, "ti").join(f, "ti")
    x = x.withColumn("tp", F.col("tp") + F.col("in_pos") - F.col("out_pos")).withColumn("fp", F.col("fp") + F.col("in_neg") - F.col("out_neg")).withColumn("fn", F.col("n_pos") - F.col("tp"))
    return x.select("th", "gap_in", "level_in", "gap_out", "level_out", "tp", "fp", "fn", M.f1_of().alias("f1"))


def packed(h: DataFrame) -> Column:
    """A histogram whose size is fixed by the grid, as one array value."""
    return h.agg(F.collect_list(F.struct(*h.columns)).alias("h")).scalar()


def cell_sum(cond, field: str, arr: str = "h") -> Column:
    return F.aggregate(F.filter(arr, cond), F.lit(0).cast("bigint"), lambda a, c: a + c[field])


def flip_grid(df: DataFrame, p: str, err: str, ths: list[float], errs: list[float]) -> DataFrame:
    """Flip decisions whose error score passes a limit: both ways, only up, only down. One two-dimensional histogram."""
    def passed(c, vals):
        return sum(((F.col(c) > float(v)).cast("int") for v in vals), F.lit(0))

    h = df.groupBy(passed(p, ths).alias("bp"), passed(err, errs).alias("be")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    cells = [(i, float(t), j, float(e), m) for i, t in enumerate(ths) for j, e in enumerate(errs) for m in ("both", "up", "down")]
    x = df.sparkSession.createDataFrame(cells, "ti int, th double, ei int, err double, mode string").withColumn("h", packed(h))

    def pred(c):
        up, fl = c["bp"] > F.col("ti"), c["be"] > F.col("ei")
        return F.when(F.col("mode") == "both", up != fl).when(F.col("mode") == "up", up | fl).otherwise(up & ~fl)

    g = x.select("mode", "th", "err", cell_sum(pred, "pos").alias("tp"), cell_sum(pred, "neg").alias("fp"), cell_sum(lambda c: ~pred(c), "pos").alias("fn"))
    return M.with_rates(g)
