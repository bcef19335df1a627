"""Boosters and randomised trees against small NumPy versions that grow one tree at a time over all rows."""
import numpy as np
import pytest

from meterloom.operators import boosting, extra_trees


def rows(n=240, d=5, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, d)), 1)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (r.random(n) < 0.1)).astype(int)
    return np.arange(n) * 3, x, y, np.arange(n) % 3


EDGES = np.tile(np.linspace(-1.5, 1.5, 9), (5, 1))


@pytest.fixture(scope="module")
def table(spark):
    ids, x, y, fold = rows()
    return spark.createDataFrame([(int(i), int(a), int(f), [float(z) for z in v]) for i, v, a, f in zip(ids, x, y, fold)], "id long, y int, fold int, vec array<double>").repartition(5)



def grown(bins, g, h, s):
    """The leaf (as a number) of every row of `bins` by a tree grown on the rows where h is positive, one split at a time."""
    def value(m):
        return (g[m].sum() / 2**24) ** 2 / (h[m].sum() / 2**24 + s.l2)

    train = h > 0
    leaf = np.zeros(len(bins), int)
    if s.growth == "symmetric":
        for level in range(s.depth):
            best = None
            for f in range(bins.shape[1]):
                for c in range(EDGES.shape[1]):
                    total = sum(value(train & (leaf == k) & (bins[:, f] <= c)) + value(train & (leaf == k) & (bins[:, f] > c)) - value(train & (leaf == k)) for k in np.unique(leaf[train]))
                    if best is None or total > best[0] + 1e-12:
                        best = total, f, c
            if best[0] <= s.least_gain:
                break
            leaf = leaf * 2 + (bins[:, best[1]] > best[2])
        return leaf
    depth, count, cand = {0: 0}, 1, {}
    while True:
        for k in depth:
            if k not in cand:
                cand[k] = None
                own = train & (leaf == k)
                for f in range(bins.shape[1]) if depth[k] < s.depth else ():
                    for c in range(EDGES.shape[1]):
                        a, b = own & (bins[:, f] <= c), own & (bins[:, f] > c)
                        if a.sum() >= s.least_rows and b.sum() >= s.least_rows:
                            v = value(a) + value(b) - value(own)
                            if v > s.least_gain and (cand[k] is None or v > cand[k][0] + 1e-12):
                                cand[k] = v, f, c
        able = [k for k in depth if cand[k]]
        if not able or s.growth == "leaf" and len(depth) >= s.leaves:
            return leaf
        k = max(able, key=lambda k: cand[k][0])
        _, f, c = cand[k]
        right = (leaf == k) & (bins[:, f] > c)
        leaf[right] = count
        depth[count] = depth[k] = depth[k] + 1
        del cand[k]
        count += 1


def boosted(ids, x, y, fold, own, s):
    bins = np.stack([np.searchsorted(EDGES[k], x[:, k], "left") for k in range(x.shape[1])], axis=1)
    out = fold != own
    held = out & ((ids * 7919 + 1000 + own) % 10007 % 10 == 0)
    train = out & ~held
    segment = (ids * 7919 + 77) % 10007 % s.segments
    score = np.full(len(y), np.log((y[out].sum() + 0.5) / (out.sum() - y[out].sum() + 0.5)))
    kept, best, since = score.copy(), None, 0
    for t in range(s.rounds + 1):
        loss = np.rint((np.logaddexp(0, score[held]) - y[held] * score[held]) * 2**24).sum()
        if best is None or loss < best:
            best, kept, since = loss, score.copy(), 0
        else:
            since += 1
        if since >= s.patience or t == s.rounds:
            break
        p = 1 / (1 + np.exp(-score))
        g, h = np.where(train, np.rint((p - y) * 2**24), 0), np.where(train, np.rint(p * (1 - p) * 2**24), 0)
        leaf = grown(bins, g, h, s)
        step = np.zeros(len(y))
        for i in range(len(y)):
            m = train & (leaf == leaf[i])
            if s.segments > 1 and train[i]:
                m &= segment < segment[i]
            step[i] = -s.rate * (g[m].sum() / 2**24) / (h[m].sum() / 2**24 + s.l2)
        score = score + step
    return 1 / (1 + np.exp(-kept))


@pytest.mark.parametrize("style", [boosting.Style("leaf", rounds=6, leaves=5, depth=4, rate=0.3), boosting.Style("level", rounds=5, depth=3, rate=0.5, patience=2),
                                   boosting.Style("symmetric", rounds=6, depth=3, segments=4, rate=0.5), boosting.Style("symmetric", rounds=4, depth=2)])
def test_boosters_match_numpy(table, style):
    ids, x, y, fold = rows()
    got = {r.id: r.p for r in boosting.oof(table, {"m": style}, 3, edges=EDGES, refresh=2).collect()}
    assert len(got) == len(ids)
    for own in range(3):
        want = boosted(ids, x, y, fold, own, style)
        assert np.allclose([got[int(i)] for i in ids[fold == own]], want[fold == own], atol=1e-9)


def test_boosters_learn_and_give_leaves(table):
    fitted = boosting.fit(table, {"a": boosting.Style("leaf", rounds=15, rate=0.3), "b": boosting.Style("level", rounds=15, rate=0.3)}, 3)
    got = boosting.out_of_fold(*fitted, leaves=20).toPandas()
    assert set(got.model) == {"a", "b"} and (got.groupby("model").id.nunique() == 240).all()
    for _, part in got.groupby("model"):
        assert ((part.p > 0.5) == (part.y == 1)).mean() > 0.75 and all(len(v) == 20 and v[-1] == -1 for v in part.leaves)


def test_missing_values_and_empty_table(spark, table):
    odd = spark.createDataFrame([(i, i % 2, i % 3, [float("nan") if i % 4 < 2 else 0.0, None, 1.0]) for i in range(90)], "id long, y int, fold int, vec array<double>")
    assert boosting.oof(odd, {"m": boosting.Style("level", rounds=2)}, 3).where("p is null or isnan(p)").count() == 0
    assert boosting.oof(table.limit(0), {"m": boosting.Style("leaf", rounds=2)}, 3, edges=EDGES).count() == 0
    assert extra_trees.oof(table.limit(0), extra_trees.Forest(trees=2), 3, edges=EDGES).count() == 0


def test_extra_trees_match_numpy(table):
    ids, x, y, fold = rows()
    forest = extra_trees.Forest(trees=4, depth=5, least_rows=3)
    bins = np.stack([np.searchsorted(EDGES[k], x[:, k], "left") for k in range(5)], axis=1)
    got = {r.id: r.p for r in extra_trees.oof(table, forest, 3, edges=EDGES).collect()}
    spread = lambda m: y[m].sum() * (m.sum() - y[m].sum()) / max(m.sum(), 1)
    for own in range(3):
        p = np.zeros(len(ids))
        for k in range(forest.trees):
            todo, number, shares = [(0, np.ones(len(ids), bool), np.zeros(5, int), np.full(5, 9), 0)], 1, np.zeros(len(ids))
            while todo:
                node, m, lo, hi, level = todo.pop(0)
                own_rows = m & (fold != own)
                shares[m] = y[own_rows].mean()
                if level >= forest.depth or level and (not 0 < y[own_rows].sum() < own_rows.sum() or own_rows.sum() < 2 * forest.least_rows):
                    continue
                r = np.random.default_rng([forest.seed, own, k, node])
                left = np.flatnonzero(hi > lo)
                pick = r.choice(left, min(len(left), 2), replace=False) if len(left) else left
                cuts = r.integers(lo[pick], hi[pick])
                best = None
                for f, c in zip(pick, cuts):
                    a, b = own_rows & (bins[:, f] <= c), own_rows & (bins[:, f] > c)
                    v = spread(own_rows) - spread(a) - spread(b) if a.sum() >= 3 and b.sum() >= 3 else -1
                    if best is None or v > best[0]:
                        best = v, f, c
                if best is None or best[0] <= 0:
                    continue
                _, f, c = best
                lo2, hi2 = lo.copy(), hi.copy()
                hi2[f], lo2[f] = c, c + 1
                todo += [(number, m & (bins[:, f] <= c), lo, hi2, level + 1), (number + 1, m & (bins[:, f] > c), lo2, hi, level + 1)]
                number += 2
            p += shares / forest.trees
        assert np.allclose([got[int(i)] for i in ids[fold == own]], p[fold == own])
