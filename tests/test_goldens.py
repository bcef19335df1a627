"""Operators against independent NumPy code or hand-computed values on small fixtures, skewed ones included."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.functions.dates import parse_headers
from meterloom.operators import (clean, complexity, conformal, folds, isolation, learn, metrics, neighbours, panel, peaks, pool,
                                 ranking, runs, sampling, spectral)
from meterloom.operators.clean import normal_quantile
from meterloom.session import cut_lineage
from meterloom.sources import sinks, wide

DAY0 = dt.date(2020, 1, 1)


def readings(spark, series):
    """series: id -> list of values with None for missing days."""
    rows = [(k, DAY0 + dt.timedelta(d), float(v)) for k, vs in series.items() for d, v in enumerate(vs) if v is not None]
    return spark.createDataFrame(rows, "series_id bigint, dt date, value double")


def dense(spark, series):
    return panel.densify(readings(spark, series)).withColumn("f", F.coalesce("value", F.lit(0.0)))


# ---------------------------------------------------------------- distributed ranks and quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value a third of them."""
    rng = np.random.default_rng(1)
    rows = [("hot", 0.5, int(rng.random() < 0.3)) for _ in range(20000)]
    rows += [("hot", float(x), int(rng.random() < 0.5)) for x in np.round(rng.beta(0.2, 3, 30000), 6)]
    rows += [("cold", float(x), int(rng.random() < 0.5)) for x in rng.random(50)]
    return rows, spark.createDataFrame(rows, "model string, p double, y int").repartition(13)


def test_running_totals_skew(spark, skewed):
    rows, df = skewed
    got = ranking.running_totals(df, "p", {"pos": F.col("y"), "c": F.lit(1)}, ["model"], buckets=16).collect()
    for model in ("hot", "cold"):
        vals = sorted((p, y) for m, p, y in rows if m == model)
        p, y = np.array([v[0] for v in vals]), np.array([v[1] for v in vals])
        part = {r.key: r for r in got if r.model == model}
        assert set(part) == set(p)
        for k, r in part.items():
            assert r.c == (p == k).sum() and r.c_before == (p < k).sum() and r.c_all == len(p)
            assert r.pos_before == y[p < k].sum()


def test_auc_and_ap_skew(skewed):
    rows, df = skewed
    auc = {r.model: r.auc for r in metrics.roc_auc(df, ["model"]).collect()}
    ap = {r.model: r.ap for r in metrics.average_precision(df, ["model"]).collect()}
    for model in auc:
        p = np.array([r[1] for r in rows if r[0] == model])
        y = np.array([r[2] for r in rows if r[0] == model])
        order = np.argsort(p, kind="stable")
        _, inv, cnt = np.unique(p[order], return_inverse=True, return_counts=True)
        rank = (np.cumsum(cnt) - (cnt - 1) / 2)[inv]
        n1 = y.sum()
        assert auc[model] == pytest.approx((rank[y[order] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)), abs=1e-12)
        ks = np.unique(p)[::-1]
        tp = np.array([y[p >= k].sum() for k in ks[:2000]])
        n = np.array([(p >= k).sum() for k in ks[:2000]])
        if len(ks) <= 2000:
            assert ap[model] == pytest.approx((np.diff(np.r_[0, tp]) / n1 * tp / n).sum(), abs=1e-12)


def test_auc_flips(skewed):
    _, df = skewed
    a = {r.model: r.auc for r in metrics.roc_auc(df, ["model"]).collect()}
    b = {r.model: r.auc for r in metrics.roc_auc(df.withColumn("p", -F.col("p")), ["model"]).collect()}
    assert all(a[m] + b[m] == pytest.approx(1) for m in a)


@pytest.mark.parametrize("n", [1, 2, 7, 101, 60000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.lognormal(0, 2, n), 3)
    x[: n // 3] = 1.0
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(5)
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.9, "e": 0.999, "f": 1.0}
    r = ranking.exact_quantiles(df, "v", probs).first()
    for k, q in probs.items():
        assert r[k] == pytest.approx(np.quantile(x, q), rel=1e-12)
    hi = ranking.exact_quantiles(df, "v", probs, higher=True).first()
    for k, q in probs.items():
        assert hi[k] == pytest.approx(np.quantile(x, q, method="higher"), rel=1e-12)


def test_degenerate_scores(spark):
    df = spark.createDataFrame([("same", 0.5, 1), ("same", 0.5, 0), ("one", 0.2, 1), ("one", 0.9, 1)], "model string, p double, y int")
    auc = {r.model: r.auc for r in metrics.roc_auc(df, ["model"]).collect()}
    assert auc == {"same": 0.5, "one": 0.5}
    none = metrics.best_f1(df.withColumn("p", F.lit(0.01)), ["model"]).collect()
    assert all(r.threshold == 0.5 and r.f1 == 0 for r in none)


def test_threshold_strict_and_inclusive(spark):
    df = spark.createDataFrame([(0.2, 1), (0.2, 0), (0.25, 1)], "p double, y int")
    t = {round(r.th, 3): r for r in metrics.threshold_table(df, None, (150, 300, 50)).collect()}
    assert (t[0.2].tp, t[0.2].fp) == (1, 0)
    t = {round(r.th, 3): r for r in metrics.threshold_table(df, None, (150, 300, 50), inclusive=True).collect()}
    assert (t[0.2].tp, t[0.2].fp, t[0.25].tp) == (2, 1, 1)


def test_published_counts(spark):
    """F1, recall and precision follow from the counts (hand-checked)."""
    c = spark.createDataFrame([(30, 10, 20, 40)], "tp bigint, fp bigint, fn bigint, tn bigint")
    r = metrics.classification_report(c).first()
    assert (r.f1, r.recall, r.precision, r.accuracy) == (60 / 90, 0.6, 0.75, 0.7)
    assert r.kappa == pytest.approx(0.4) and r.mcc == pytest.approx((30 * 40 - 10 * 20) / math.sqrt(40 * 50 * 50 * 60))


def test_student_tail(spark):
    r = spark.range(1).select(metrics.student_two_sided(F.lit(2.776445105), 4).alias("a"), metrics.student_two_sided(F.lit(2.570581836), 5).alias("b"),
                              metrics.student_two_sided(F.lit(12.7062047), 1).alias("c")).first()
    assert all(v == pytest.approx(0.05, abs=1e-6) for v in r)


# ---------------------------------------------------------------- panels


def test_densify_edges(spark):
    p = dense(spark, {1: [None, None, 5, None, 7, None], 2: [1, 1, 1, 1, 1, 1], 3: [None] * 5 + [9]})
    rows = {(r.series_id, r.day_idx): r.value for r in p.collect()}
    assert len(rows) == 18
    assert [rows[1, d] for d in range(6)] == [None, None, 5, None, 7, None]
    assert [rows[3, d] for d in range(6)] == [None] * 5 + [9]


def test_interpolation_holds_edges(spark):
    x = clean.interpolate(dense(spark, {1: [None, 2, None, None, 5, None], 2: [1] + [None] * 4 + [1]}))
    v = {(r.series_id, r.day_idx): r.filled for r in x.collect()}
    assert [v[1, d] for d in range(6)] == [2, 2, 3, 4, 5, 5]
    short = clean.interpolate(dense(spark, {1: [None, 2, None, None, 5, None], 2: [1] + [None] * 4 + [1]}), max_gap=2, hold_edges=False)
    v = {(r.series_id, r.day_idx): r.filled for r in short.collect()}
    assert [v[1, d] for d in range(6)] == [None, 2, 3, 4, 5, None]
    assert v[2, 2] is None


def test_neighbours_from_sparse_rows_equal_windows(spark):
    r = readings(spark, {1: [None, 2, None, None, 5, None], 2: [1] + [None] * 4 + [1], 3: [None] * 5 + [9]})
    a = clean.interpolate(panel.densify(r)).select("series_id", "day_idx", "filled").collect()
    b = clean.interpolate(panel.densify(r, neighbours=True)).select("series_id", "day_idx", "filled").collect()
    assert sorted(a) == sorted(b)


def test_sparsity_gate(spark):
    """Day 2 is missing for most series: its gaps take the median, the interpolation of the others skips it."""
    x = clean.impute_by_sparsity(readings(spark, {1: [0, 10, 50, 30, 40], 2: [2, None, None, 6, None], 3: [1, 1, None, 1, 1], 4: [5, 5, None, 5, 5]}))
    v = {(r.series_id, r.day_idx): (r.dense, r.filled) for r in x.collect()}
    assert [v[2, d][1] for d in range(5)] == [2, 4, 50, 6, 6]
    assert [v[1, d][0] for d in range(5)] == [True, True, False, True, True]


@pytest.mark.parametrize("width", [3, 4, 7])
def test_moving_average_edges(spark, width):
    x = [3.0, 1, 4, 1, 5, 9, 2, 6, 5, 3]
    got = [r.m for r in dense(spark, {1: x}).withColumn("m", panel.moving_average("f", width)).orderBy("day_idx").collect()]
    pad = np.pad(x, (width // 2, width - width // 2 - 1), mode="edge")
    assert got == pytest.approx([pad[i:i + width].mean() for i in range(len(x))])
    mir = [r.m for r in panel.moving_average_mirrored(dense(spark, {1: x}), "f", width, "m").orderBy("day_idx").collect()]
    pad = np.pad(x, (width // 2, width - width // 2 - 1), mode="symmetric")
    assert mir == pytest.approx([pad[i:i + width].mean() for i in range(len(x))])


@pytest.mark.parametrize("n,s", [(40, 7), (37, 25), (50, 50)])
def test_segments(spark, n, s):
    got = {r.d: r.s for r in spark.range(n).select(F.col("id").cast("int").alias("d"), clean.segment_of(s, F.col("id").cast("int"), F.lit(n)).alias("s")).collect()}
    for i in range(s):
        for d in range(round(i * n / s), round((i + 1) * n / s)):
            assert got[d] == i


def test_winsor_folds_do_not_leak(spark):
    base = {k: [float(k + d) for d in range(12)] for k in range(6)}
    other = {**base, 0: [1000.0] * 12}
    f = spark.createDataFrame([(k, k % 3) for k in range(6)], "series_id bigint, fold int")
    a = {r.fold: (r.lo, r.hi) for r in clean.winsorize_by_fold(dense(spark, base), f, 3).select("fold", "lo", "hi").distinct().collect()}
    b = {r.fold: (r.lo, r.hi) for r in clean.winsorize_by_fold(dense(spark, other), f, 3).select("fold", "lo", "hi").distinct().collect()}
    assert a[0] == b[0] and a[1] != b[1]


def test_normal_quantile(spark):
    from statistics import NormalDist
    ps = [1e-6, 0.01, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-6)


# ---------------------------------------------------------------- runs and change-points


def test_runs_touch_both_ends(spark):
    x = [0, 0, 1, 0, 1, 1, 0, 0, 0]
    r = runs.runs(dense(spark, {1: x}), F.col("f") == 0).orderBy("start").collect()
    assert [(q.start, q.length) for q in r] == [(0, 2), (3, 1), (6, 3)]
    s = runs.run_stats(dense(spark, {1: x, 2: [1] * 9}), F.col("f") == 0).orderBy("series_id").collect()
    assert [(q.run_count, q.run_longest, q.run_mean) for q in s] == [(3, 3, 2.0), (0, 0, 0.0)]


def _loop_cusum(x, reject=True):
    n = len(x)
    ref = x[: min(n // 2, 200)]
    mu, sd = ref.mean(), ref.std() + 1e-6
    sp = sn = 0.0
    up = down = -1
    for t, v in enumerate(x):
        sp, sn = max(0, sp + v - mu - 0.2 * sd), max(0, sn + mu - 0.2 * sd - v)
        up = t if sp > 3 * sd and up < 0 else up
        down = t if sn > 3 * sd and down < 0 else down
    hits = [h for h in (up, down) if h >= 0]
    if not hits:
        return -1
    cp = min(hits)
    drop = down >= 0 and (up < 0 or down <= up)
    if cp < 30 or cp > n - 30:
        return -1
    ratio = x[cp:].mean() / (x[:cp].mean() + 1e-6)
    return -1 if reject and ((drop and ratio > 0.95) or (not drop and ratio < 1.05)) else cp


def test_cusum_equals_recursion(spark):
    rng = np.random.default_rng(5)
    series = {k: np.round(np.r_[rng.normal(20, 3, 80), rng.normal(20 + (k % 5 - 2) * 4, 3, 80)], 3) for k in range(20)}
    got = {r.series_id: r.cp for r in runs.cusum_shift(dense(spark, {k: list(v) for k, v in series.items()}), "value", F.col("value").isNotNull()).collect()}
    assert got == {k: _loop_cusum(v) for k, v in series.items()}
    assert any(v > 0 for v in got.values())


# ---------------------------------------------------------------- complexity and spectra


def test_sample_entropy_brute_force():
    x = np.random.default_rng(3).normal(size=60).round(2)
    r = 0.2 * x.std()

    def count(m):
        t = [x[i:i + m] for i in range(len(x) - m)]
        return sum(np.abs(t[i] - t[j]).max() < r for i in range(len(t)) for j in range(i + 1, len(t)))

    assert complexity.sample_entropy_of(x) == pytest.approx(-math.log(count(3) / count(2)))
    assert complexity.sample_entropy_of(np.ones(50)) == 0 and complexity.sample_entropy_of([1.0, 2.0]) == 0


def test_lempel_ziv_orders_regularity():
    rng = np.random.default_rng(0)
    regular, noise = np.tile([1.0, 2, 3, 4, 5], 40), rng.random(200)
    assert complexity.lempel_ziv_of(regular) < complexity.lempel_ziv_of(noise)
    assert complexity.lempel_ziv_of(np.ones(30)) == 0


def test_fuzzy_entropy_brute_force():
    x = np.random.default_rng(4).normal(size=40)
    c = x - x.mean()
    r = 0.15 * x.std() + 1e-12

    def phi(m):
        t = [c[i:i + m] for i in range(len(c) - m + 1)]
        return np.mean([np.mean([math.exp(-((a - b) ** 2).sum() / r ** 2) for j, b in enumerate(t) if j != i]) for i, a in enumerate(t)])

    assert complexity.fuzzy_entropy_of(x) == pytest.approx(math.log(phi(2)) - math.log(phi(3)))


def test_peaks(spark):
    x = [0, 3, 0, 0, 5, 5, 5, 0, 1, 0, 0, 0, 0, 0, 4, 0.0]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, i, 1.0) for i in range(9)], "series_id long, pos int, value double")
    at = lambda d: sorted(r.at for r in peaks.local_peaks(df, distance=d).where("series_id = 1 and side = 1").collect())
    assert at(1) == [1, 5, 8, 14] and at(7) == [5, 14]
    got = {r.series_id: (r.n_peaks, r.n_valleys) for r in peaks.peak_features(df).collect()}
    assert got[2] == (0, 0) and got[1][0] == 2


def test_sine_period(spark):
    t = np.arange(210)
    p = dense(spark, {1: list(10 + np.sin(2 * np.pi * t / 7)), 2: list(10 + np.sin(2 * np.pi * t / 30))})
    r = {q.series_id: q for q in spectral.period_power(p).collect()}
    assert r[1].power_weekly == pytest.approx(1, abs=1e-6) and r[2].power_monthly == pytest.approx(1, abs=1e-6)
    s = {q.series_id: q for q in spectral.spectral_summary(spectral.spectrum(panel.series_arrays(p, "f"))).collect()}
    assert s[1].dominant_period == pytest.approx(7, abs=1e-4) and s[2].dominant_period == pytest.approx(30, abs=1e-4)


def test_band_shares_sum_to_one(spark):
    x = np.random.default_rng(8).random(120)
    r = spectral.fft_block(spectral.spectrum(panel.series_arrays(dense(spark, {1: list(x)}), "f"))).first()
    assert sum(r[f"band_{b}"] for b in range(8)) == pytest.approx(1)


def test_edge_series(spark):
    """All zero, constant, one point and short series give finite defaults everywhere."""
    from meterloom.operators import profiles as R, series_stats as S
    p = dense(spark, {1: [0.0] * 90, 2: [4.0] * 90, 3: [None] * 89 + [2.0], 4: [1.0, 2.0] + [None] * 88})
    obs = panel.observed_positions(readings(spark, {1: [0.0] * 90, 2: [4.0] * 90, 3: [None] * 89 + [2.0], 4: [1.0, 2.0]}))
    frames = [S.basic(obs), S.moments(obs), S.differences(obs), S.trend(obs), S.autocorrelation(obs), S.autocovariance_ratio(p), S.zero_missing(p),
              R.multiscale_regularity(p), R.patch_features(p), R.ljung_box(p), complexity.permutation_entropy(obs, order=3), complexity.tail_shape(obs),
              complexity.distribution_shape(obs), complexity.burstiness(obs), complexity.hurst_dfa(obs), complexity.time_asymmetry(obs), spectral.cascade_stats(p), spectral.component_stats(p)]
    for f in frames:
        for r in f.collect():
            for c, v in r.asDict().items():
                assert v is None or not isinstance(v, float) or math.isfinite(v), (f.columns, c, r)


# ---------------------------------------------------------------- neighbours


def _cloud(n=400, copies=150, d=6):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, d)).round(3)
    x[:copies] = x[0] + rng.normal(scale=1e-3, size=(copies, d)).round(5)  # a dense clump of near copies
    return x


def test_neighbours_brute_force_with_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 32)
    x = _cloud()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>").repartition(6)
    got = {}
    for r in neighbours.nearest_neighbours(df, df, 7, pivots=9).collect():
        got.setdefault(r.id, []).append((r["rank"], r.nid, r.dist))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(x)
    for i, rows in got.items():
        assert [q[2] for q in sorted(rows)] == pytest.approx(list(np.sort(d[i])[:7]), abs=1e-9)


def test_lof_flags_outlier(spark):
    x = np.vstack([np.random.default_rng(1).normal(size=(120, 3)), [[9, 9, 9]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    e = cut_lineage(neighbours.nearest_neighbours(df, df, 10))
    lof = {r.id: r.lof for r in neighbours.local_outlier_factor(e, e).collect()}
    iso = {r.id: r.isolation for r in isolation.isolation_scores(df, trees=50, sample=64).collect()}
    assert max(lof, key=lof.get) == 120 and max(iso, key=iso.get) == 120


# ---------------------------------------------------------------- pool, conformal, sampling, learners


def test_gram_nnls_and_prune(spark):
    rng = np.random.default_rng(6)
    p = rng.random((300, 4))
    p[:, 3] = p[:, 0] * 0.999 + 0.0005
    y = (0.7 * p[:, 0] + 0.3 * p[:, 2] > 0.5).astype(int)
    m = spark.createDataFrame([(i, int(a), [float(v) for v in r]) for i, (a, r) in enumerate(zip(y, p))], "id bigint, y int, p array<double>").repartition(5)
    c = pool.correlation_array(m)
    assert np.allclose(c, np.corrcoef(p.T))
    assert pool.prune_in_order(c, [0, 1, 2, 3], 0.999) == [0, 1, 2]
    assert pool.prune_by_clusters(c, 0.9, np.ones(4)) == [0, 1, 2, 3]  # no cluster may hold a pair above the limit
    assert len(pool.prune_by_clusters(c, 1.1, np.ones(4))) == 2
    w = pool.nnls_from_gram(p.T @ p, p.T @ y)
    g = p.T @ y - p.T @ p @ w
    assert (w >= 0).all() and (g <= 1e-6).all() and np.abs(g * w).max() < 1e-6
    f1 = pool.f1_of_weights(m, np.eye(4))
    th = metrics.grid_values(metrics.GRID)
    want = [max(2 * ((p[:, k] > t) & (y == 1)).sum() / max((p[:, k] > t).sum() + y.sum(), 1) for t in th) for k in range(4)]
    assert f1 == pytest.approx(want)
    steps = pool.greedy_forward(m, 4)
    assert [s[2] for s in steps] == sorted(s[2] for s in steps)


def test_votes_with_ties(spark):
    m = spark.createDataFrame([(1, 1, [0.6, 0.6, 0.4, 0.4]), (2, 0, [0.6, 0.6, 0.6, 0.4]), (3, 0, [0.5, 0.5, 0.5, 0.5])], "id bigint, y int, p array<double>")
    r = {q.id: (q.n_votes, q.clean, q.issue) for q in pool.consensus_labels(m, 4).collect()}
    assert r == {1: (2, 0, True), 2: (3, 1, True), 3: (0, 0, False)}


def test_conformal(spark):
    s = spark.createDataFrame([(float(v),) for v in range(1, 20)], "s double")
    q = {round(r.alpha, 2): r.q_hat for r in conformal.conformal_quantiles(s, (0.1, 0.5, 0.01)).collect()}
    assert q == {0.1: 19.0, 0.5: 11.0, 0.01: 19.0}  # numpy: quantile(level, method='higher')
    scored = spark.createDataFrame([(float(i % 97) / 97, int(i % 3 == 0)) for i in range(900)], "p double, y int").withColumn("s", conformal.true_class_score()).withColumn("g", F.lit("a"))
    c = conformal.coverage_curve(scored, conformal.conformal_quantiles(scored, by=["g"]), ["g"]).orderBy("alpha").collect()
    cov = [r.coverage for r in c]
    assert cov == sorted(cov, reverse=True)


def test_stratified_folds(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "series_id bigint, y int")
    f = folds.stratified_folds(df, 5).groupBy("y", "fold").count().collect()
    assert {(r.y, r["count"]) for r in f} == {(0, 180), (1, 20)}


def test_group_folds_never_split_and_balance(spark):
    df = spark.createDataFrame([("big",)] * 400 + [(f"g{i % 60}",) for i in range(600)], "g string")
    f = sampling.group_folds(df, "g", 4)
    assert f.count() == 61 and f.select("g").distinct().count() == 61


def test_smote_balances_and_stays_on_segments(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i < 20), [float(v) for v in (rng.normal(size=2) + (5 if i < 20 else 0))]) for i in range(100)]
    out = sampling.smote(spark.createDataFrame(rows, "id bigint, y int, vec array<double>")).collect()
    n1 = sum(r.y for r in out)
    assert abs(n1 - 80) <= 20
    new = np.array([r.vec for r in out if r.id < 0])
    lo, hi = np.array([r[2] for r in rows[:20]]).min(0), np.array([r[2] for r in rows[:20]]).max(0)
    assert len(new) and (new >= lo - 1e-9).all() and (new <= hi + 1e-9).all()


def test_oof_scores_every_row_once(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 4 == 0), i % 3, float(rng.normal() + 3 * (i % 4 == 0)), float(rng.normal())) for i in range(240)]
    df = cut_lineage(learn.with_features(spark.createDataFrame(rows, "id bigint, y int, fold int, a double, b double"), ["a", "b"]))
    s = learn.oof(df, lambda k: learn.forest(k, 5, 3), 3)
    assert s.count() == 240 and s.select("id").distinct().count() == 240
    assert metrics.roc_auc(s).first().auc > 0.8


# ---------------------------------------------------------------- sources and sinks


def test_wide_csv_with_malformed_header(spark, tmp_path):
    path = str(tmp_path / "wide.csv")
    with open(path, "w") as f:
        f.write("CONS_NO,FLAG,1/1/2014,1/2/2014,13/45/20,notes\n" + "".join(f"m{i},{i % 2},{i}.5,,{i},x\n" for i in range(6)))
    long = wide.unpivot_meters(wide.read_wide_csv(spark, path))
    assert long.count() == 18
    got = {(r.series_id, str(r.dt)): r.value for r in long.collect()}
    assert got["m3", "2014-01-01"] == 3.5 and got["m3", "2014-01-02"] is None and got["m3", "2000-01-01"] == 3.0
    h = parse_headers(spark.createDataFrame([("2/29/2016",), ("broken",)], "header string"), "header").collect()
    assert [(r.year, r.month, r.day, r.season, r.weekday) for r in h] == [(2016, 2, 29, 2, 0), (2000, 1, 1, 6, 0)]


def test_stage_store_computes_once(spark, tmp_path):
    store, calls = sinks.StageStore(spark, str(tmp_path)), []

    def make():
        calls.append(1)
        return spark.range(20).withColumn("model", F.concat(F.lit("m"), F.col("id") % 2))

    assert store.cache_or_compute("x", make, ["model"]).count() == 20
    assert store.cache_or_compute("x", make, ["model"]).count() == 20 and len(calls) == 1


def test_bucketed_table_needs_no_shuffle(spark, tmp_path):
    t = sinks.save_bucketed(spark.range(100).withColumn("v", F.col("id") % 7), "bucketed_panel", str(tmp_path / "b"), "v", 4)
    g = t.groupBy("v").agg(F.count("*").alias("n"))
    assert "Exchange" not in g._jdf.queryExecution().executedPlan().toString() and g.count() == 7
    spark.sql("drop table bucketed_panel")


def test_per_series_windows_add_no_shuffle(spark):
    """After densification, windows and aggregates on the series reuse its partitioning."""
    p = dense(spark, {1: [1, 2, None, 4], 2: [None, 3, 3, None]}).withColumn("m", panel.moving_average("f", 3))
    plan = p.groupBy("series_id").agg(F.avg("m"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(series_id") == 1


def test_same_result_for_other_partitioning(spark, skewed):
    _, df = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append({r.model: (r.threshold, r.f1) for r in metrics.best_f1(df, ["model"]).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


@pytest.mark.parametrize("offset,spread", [(0.0, 1.0), (1e3, 1e-3), (1e4, 1e-2)])
def test_neighbours_are_exact_anywhere(spark, offset, spread):
    """Far from the origin, with ties and a clump of copies, in any number of cells."""
    r = np.random.default_rng(5)
    x = offset + spread * r.normal(size=(400, 6))
    x[50:120] = x[50]
    x[200:260, :] = offset + spread * np.round(r.normal(size=(60, 6)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    got = {}
    for row in neighbours.nearest_neighbours(df, df, 5, pivots=7).collect():
        got.setdefault(row.id, []).append((row.rank, row.nid))
    for i in range(len(x)):
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        d[i] = np.inf
        assert [n for _, n in sorted(got[i])] == np.lexsort((np.arange(len(x)), d))[:5].tolist()


def test_smote_equal_classes(spark):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, int(i < 17), r.normal(size=3).tolist()) for i in range(90)], "id bigint, y int, vec array<double>")
    assert {r.y: r["count"] for r in sampling.smote(df).groupBy("y").count().collect()} == {0: 73, 1: 73}


def test_quantiles_split_their_brackets(spark):
    """Ten million distinct values: no window of the plan holds more than a small share of what a bracket keeps."""
    n = 10_000_000
    df = spark.range(n).select(F.pmod(F.col("id") * 7919 + 11, F.lit(n)).cast("double").alias("v"))
    got = ranking.exact_quantiles(df, "v", {"a": .1, "b": .5, "c": .999}).first()
    assert [got.a, got.b, got.c] == pytest.approx([(n - 1) * q for q in (.1, .5, .999)])
    skew = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") == 1, 1e300).otherwise(F.exp(F.col("id") / 9000.0)).alias("v"), (F.col("id") % 2).alias("g"))
    rows = {r.g: r for r in ranking.exact_quantiles(skew, "v", {"lo": 0.0, "m": .5, "p": .997, "hi": 1.0}, ["g"]).collect()}
    x = skew.toPandas()
    for g, part in x.groupby("g").v:
        assert list(rows[g])[1:] == pytest.approx(np.quantile(part, [0, .5, .997, 1.0]).tolist())
