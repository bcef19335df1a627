import numpy as np
import pytest

from meterloom.operators import hulls, isotonic


def pooled(p, y):
    """Blocks by the classic stack: [least score, greatest score, value]."""
    out = []
    for x in sorted(set(p)):
        own = [b for a, b in zip(p, y) if a == x]
        out.append([x, x, sum(own), len(own)])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            lo, _, a, n = out.pop(-2)
            out[-1] = [lo, out[-1][1], out[-1][2] + a, out[-1][3] + n]
    return [(lo, hi, a / n) for lo, hi, a, n in out]


@pytest.mark.parametrize("seed,chunk", [(1, 1 << 17), (2, 16)])
def test_calibration_matches_the_sequential_fit(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(hulls, "CHUNK", chunk)
    r = np.random.default_rng(seed)
    p = np.round(r.random(400), 2 if seed == 1 else 6)
    y = (r.random(400) < p ** 2).astype(int)
    fold = np.arange(400) % 4
    df = spark.createDataFrame([(i, int(b), int(f), float(a)) for i, (a, b, f) in enumerate(zip(p, y, fold))], "id long, y int, fold int, p double")
    got = {x.id: x for x in isotonic.calibrated(df, 4).collect()}
    assert len(got) == 400
    for f in range(4):
        blocks = pooled(p[fold != f].tolist(), y[fold != f].tolist())
        knots = sorted({(x, v) for lo, hi, v in blocks for x in (lo, hi)})
        want = np.interp(p[fold == f], [x for x, _ in knots], [v for _, v in knots])
        assert np.allclose([got[i].p for i in np.flatnonzero(fold == f)], want, atol=1e-12)
    steps = {(s.lo, s.hi, round(s.value, 12)) for s in isotonic.steps(df, ["fold"]).where("fold = 0").collect()}
    assert steps == {(lo, hi, round(v, 12)) for lo, hi, v in pooled(p[fold == 0].tolist(), y[fold == 0].tolist())}


def test_edges(spark):
    schema = "id long, y int, fold int, p double"
    assert isotonic.calibrated(spark.createDataFrame([], schema), 3).count() == 0
    one = spark.createDataFrame([(1, 1, 0, 0.5), (2, 0, 1, 0.5), (3, 1, 2, 0.5), (4, 1, 2, None)], schema)
    assert sorted((r.id, r.p) for r in isotonic.calibrated(one, 3).where("raw is not null").collect()) == [(1, 0.5), (2, 1.0), (3, 0.5)]
