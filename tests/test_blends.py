import numpy as np
import pytest

from meterloom.operators import pool


def brute(p, y, weights, floor, width=0.05):
    """Best point of each blend over all distinct scores; then of each bin of recall, with a floor, and of all."""
    points, tops = [], []
    for c, w in enumerate(weights):
        s = np.round(p @ w, 12)
        own = []
        for t in np.unique(s):
            tp, fp = int(y[s >= t].sum()), int((1 - y)[s >= t].sum())
            own.append((round(2 * tp / (tp + fp + y.sum()), 12), -c, t, tp / y.sum(), tp / (tp + fp)))
        own = [x for x in own if x[3] > 0]
        points += own
        tops.append(max(own))
    bins = {}
    for x in tops:
        k = int(np.floor(x[3] / width + 1e-9))
        bins[k] = max(bins.get(k, x), x)
    return bins, max((x for x in points if x[3] >= floor), default=None), max(tops)


@pytest.mark.parametrize("seed,crowd,cells", [(1, 1, 200), (2, 12, 50), (3, 12, 7)])
def test_exact_blends_match_brute_force(spark, seed, crowd, cells):
    """`crowd` presses the scores towards 0 and 1, where cells of equal width see little."""
    r = np.random.default_rng(seed)
    y = (r.random(150) < 0.3).astype(int)
    z = r.normal(size=(150, 5)) + 0.8 * y[:, None]
    p = np.round(1 / (1 + np.exp(-crowd * (z - 0.5))), 9)
    w = r.dirichlet(np.ones(5), 60)
    m = spark.createDataFrame([(i, int(b), [float(x) for x in a]) for i, (a, b) in enumerate(zip(p, y))], "id long, y int, p array<double>").repartition(4)
    got = pool.exact_blends(m, w, 0.9, cells=cells).collect()
    bins, held, best = brute(p, y, w, 0.9)
    row = lambda x: (round(x.f1, 9), -x.cand, round(x.threshold, 9), round(x.recall, 9), round(x.precision, 9))
    short = lambda x: tuple(v if k == 1 else round(float(v), 9) for k, v in enumerate(x))
    assert {round(x.recall_bin / 0.05): row(x) for x in got if x.kind == "frontier"} == {k: short(x) for k, x in bins.items()}
    assert [row(x) for x in got if x.kind == "floor"] == [short(held)] and [row(x) for x in got if x.kind == "best"] == [short(best)]
    assert [row(x) for x in pool.exact_blends(m, w, cells=cells, best_only=True).collect()] == [short(best)]


@pytest.mark.parametrize("best_only", [True, False])
def test_few_rows_are_looked_at_one_by_one(spark, monkeypatch, best_only):
    """Scores that say little leave wide cells open, copies press many rows into one score; cells are split until few rows are left."""
    r = np.random.default_rng(4)
    y = (r.random(300) < 0.1).astype(int)
    p = np.round(1 / (1 + np.exp(-r.normal(size=(300, 4)))), 9)
    p[100:], y[100:250] = p[100], 1
    w = r.dirichlet(np.ones(4), 400)
    m = spark.createDataFrame([(i, int(b), [float(x) for x in a]) for i, (a, b) in enumerate(zip(p, y))], "id long, y int, p array<double>").repartition(3)
    seen, totals = [], pool.running_totals
    monkeypatch.setattr(pool, "LEFT", 500, raising=False)
    monkeypatch.setattr(pool, "running_totals", lambda rows, *a, **k: seen.append(rows.count()) or totals(rows, *a, **k))
    got = pool.exact_blends(m, w, cells=5, best_only=best_only).collect()
    assert sum(seen) <= 500
    bins, held, best = brute(p, y, w, 0.9)
    row = lambda x: (round(x.f1, 9), -x.cand, round(x.threshold, 9))
    short = lambda x: tuple(v if k == 1 else round(float(v), 9) for k, v in enumerate(x[:3]))
    assert [row(x) for x in got if x.kind == "best"] == [short(best)]
    if not best_only:
        assert [row(x) for x in got if x.kind == "floor"] == [short(held)]
        assert {round(x.recall_bin / 0.05): row(x) for x in got if x.kind == "frontier"} == {k: short(x) for k, x in bins.items()}
