import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.operators import hulls, subgroup


def test_hull_of_any_chunking(spark, monkeypatch):
    r = random.Random(4)
    rows = [(g, x, r.randrange(200)) for g in range(3) for x in sorted(r.sample(range(900), 120 if g else 1))]
    df = spark.createDataFrame(rows, "g int, x long, y long")
    want = set()
    for g in range(3):
        own = [(x, y) for a, x, y in rows if a == g]
        for i, (x, y) in enumerate(own):
            slopes = [Fraction(b - y, a - x) for a, b in own[i + 1:]]
            if i == 0 or i == len(own) - 1 or max(Fraction(y - b, x - a) for a, b in own[:i]) < min(slopes):
                want.add((g, x, y))
    monkeypatch.setattr(hulls, "WIDEN", 4)
    for size in (7, 100, 5000):
        monkeypatch.setattr(hulls, "CHUNK", size)
        assert {tuple(x) for x in hulls.lower_hull(df, ["g"], "x", "y").collect()} == want


def brute(rows, floor=None):
    """All choices of one cut for each group: the greatest F1, fewest predicted positives first."""
    total = sum(y for _, _, y in rows)
    groups = sorted({g for g, _, _ in rows})
    cuts = {g: [None, *sorted({p for a, p, _ in rows if a == g})] for g in groups}
    best = None
    for choice in itertools.product(*(cuts[g] for g in groups)):
        cut = dict(zip(groups, choice))
        hit = [y for g, p, y in rows if cut[g] is not None and p >= cut[g]]
        tp, n = sum(hit), len(hit)
        if floor is not None and tp < Fraction(floor).limit_denominator(10**9) * total:
            continue
        key = (Fraction(2 * tp, n + total) if n + total else Fraction(0), -n)
        best = key if best is None or key > best else best
    return best, total


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("floor", [None, 0.7, 0.95, 1.0])
def test_thresholds_match_all_combinations(spark, seed, floor):
    r = random.Random(seed)
    rows = [(r.randrange(3), r.randrange(8) / 8, int(r.random() < 0.4)) for _ in range(40)]
    df = spark.createDataFrame(rows, "grp int, p double, y int")
    (f1, fewer), total = brute(rows, floor)
    got = subgroup.best_thresholds(subgroup.score_points(df), total, "x", floor).collect()
    cut = {g.grp: g.threshold for g in got}
    assert set(cut) == {g for g, _, _ in rows}
    hit = [y for g, p, y in rows if cut[g] is not None and p >= cut[g]]
    assert Fraction(2 * sum(hit), len(hit) + total) == f1 and all(abs(g.f1 - float(f1)) < 1e-12 and abs(g.recall - sum(hit) / total) < 1e-12 for g in got)
    assert floor is None or sum(hit) >= floor * total


def test_hundred_groups_and_none(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(20000) < 0.2).astype(int)
    rows = [(int(g), float(p), int(a)) for g, p, a in zip(rng.integers(0, 100, 20000), rng.random(20000) * 0.7 + y * 0.3, y)]
    df = spark.createDataFrame(rows, "grp int, p double, y int")
    points = subgroup.score_points(df).cache()
    free = subgroup.best_thresholds(points, int(y.sum())).collect()
    held = subgroup.best_thresholds(points, int(y.sum()), "floor", 0.97).collect()
    assert len(free) == len(held) == 100 and held[0].recall >= 0.97 and free[0].f1 >= held[0].f1
    one = max(2 * sum(a for _, q, a in rows if q >= c) / (sum(q >= c for _, q, _ in rows) + y.sum()) for c in (0.3, 0.4, 0.5, 0.6, 0.65, 0.7))
    assert free[0].f1 >= one
    negative = df.withColumn("y", F.lit(0))
    got = subgroup.best_thresholds(subgroup.score_points(negative), 0).collect()
    assert {g.threshold for g in got} == {None} and got[0].f1 == 0
