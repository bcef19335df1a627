"""Work that grew faster than it had to: results on odd rows and the shape of the plans."""
import re
import threading

import numpy as np
from pyspark.sql import functions as F

from meterloom.operators import clean, complexity, panel, peers, profiles, spectral


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, series=12, days=80, seed=3):
    """Dense panel rows with ties and empty days."""
    r = np.random.default_rng(seed)
    rows = [(s, d, days, float(r.integers(0, 6)) if r.random() < 0.6 else 0.0) for s in range(series) for d in range(days)]
    return rows, spark.createDataFrame(rows, "series_id long, day_idx int, n_days int, f double").withColumn("dt", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day_idx")))


def test_fuzzy_entropy_meets_no_underflow(spark, monkeypatch):
    """Points far apart cost no more than near ones: the exponential never sees what would underflow."""
    least, exp = [], np.exp
    monkeypatch.setattr(complexity.np, "exp", lambda a, *o, **k: least.append(a.min()) or exp(a, *o, **k))
    x = np.zeros(400)
    x[::100] = 1000.0
    complexity.fuzzy_entropy_of(x)
    assert min(least) >= -complexity.FAR


def test_components_are_smoothed_where_entropies_are_taken(spark):
    rows, df = _rows(spark, 3, 150)
    df = df.union(df.where("series_id = 1 and day_idx < 4"))  # days that stand twice
    out = spectral.component_fuzzy_entropy(df)
    assert "Window" not in _plan(out)
    x, names = spectral.smoothing_components(df)
    want = {}
    for r in x.collect():
        want.setdefault(r.series_id, []).append((r.day_idx, *[r[c] for c in names]))
    got = {(r.series_id, r.component): r.fuzzy_entropy for r in out.collect()}
    assert len(got) == 3 * len(names)
    for s in (0, 2):
        a = np.array(sorted(want[s]))
        assert np.allclose([got[s, c] for c in names], [complexity.fuzzy_entropy_of(a[:, i + 1]) for i in range(len(names))], atol=1e-9)


def test_day_medians_keep_no_sketch_for_each_day(spark):
    rows, df = _rows(spark)
    df = df.withColumn("value", F.when(F.col("f") > 0, F.col("f")))
    out = peers.day_medians(df)
    assert "approx" not in _plan(out)
    got = {r.day_idx: r["median"] for r in out.collect()}
    want = {d: np.median([f for _, e, _, f in rows if e == d and f > 0]) for d in range(80) if any(e == d and f > 0 for _, e, _, f in rows)}
    assert got == want


def test_cluster_day_deviation_keeps_no_sketch_for_each_day(spark):
    rows, df = _rows(spark)
    out = peers.cluster_day_deviation(df, spark.range(12).selectExpr("id as series_id", "cast(id % 3 as int) as cluster"))
    assert "approx" not in _plan(out)
    v = np.array([r[3] for r in rows]).reshape(12, 80)
    for r in out.collect():
        med = np.median(v[r.series_id % 3::3], axis=0)
        assert np.allclose([r.abs_dev, r.below_share], [np.abs(v[r.series_id] - med).mean(), (v[r.series_id] < med).mean()])


def test_cohort_features_rank_values_not_days(spark):
    rows, df = _rows(spark, 10, 200)
    out = profiles.cohort_features(df, spark.range(10).selectExpr("id as series_id", "cast(id % 2 as int) as cohort"), 60)
    assert "approx" not in _plan(out) and not re.search(r"\brank\(", _plan(out))
    v = np.array([r[3] for r in rows]).reshape(10, 200)
    for r in out.collect():
        x, peer = v[r.series_id], v[r.series_id % 2::2]
        rank = np.array([(x < a).sum() + ((x == a).sum() + 1) / 2 for a in x]) / 200
        ratio = x / (np.median(peer, axis=0) + 1e-6)
        assert np.allclose([r.low_ratio, r.recent30, r.recent90, r.peer_dev, r.peer_low, r.rank_drop],
                           [(x < max(np.quantile(peer, .15), 0.01)).mean(), x[-30:].mean() / (x[:60].mean() + 1e-6), x[-90:].mean() / (x[:60].mean() + 1e-6), ratio.mean(), (ratio < 0.5).mean(),
                            rank[-90:].mean() - rank[:60].mean()])


def test_fold_bounds_count_each_row_once(spark):
    rows, df = _rows(spark)
    folds = spark.range(12).selectExpr("id as series_id", "cast(id % 3 as int) as fold")
    out = clean.winsorize_by_fold(df, folds, 3)
    assert "approx" not in _plan(out)
    v = np.array([r[3] for r in rows]).reshape(12, 80)
    got = {r.fold: r for r in out.select("fold", "lo", "hi", "p95", "p99", "p999").distinct().collect()}
    assert len(got) == 3 and out.count() == 960
    for k, r in got.items():
        assert np.allclose(r[1:], np.quantile(v[[s for s in range(12) if s % 3 != k]], [.01, .99, .95, .99, .999]))


def test_learners_pass_over_few_tasks(spark, tmp_path, monkeypatch):
    """A frame with a row for each series is held in tasks that follow its rows, not those that made the panel; folds are fitted at once."""
    from meterloom import session
    from meterloom.operators import learn
    from meterloom.plans import learn_plans

    spark.range(6_000).selectExpr("id % 300 as l_suppkey", "date_add(date'2024-01-01', cast(id % 70 as int)) as l_shipdate", "cast(id % 11 as double) as l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    session.tune(spark)
    x = learn_plans.series_frame(spark, str(tmp_path))
    assert x.count() == 300 and x.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    threads, fit = set(), learn.LogisticRegression.fit
    monkeypatch.setattr(learn.LogisticRegression, "fit", lambda self, rows: threads.add(threading.get_ident()) or fit(self, rows))
    s = learn.oof(learn.with_features(x, ["mean", "std"]), learn.logistic, 5)
    assert {r.id: r.fold for r in s.collect()} == {r.id: r.fold for r in x.collect()} and len(threads) > 1
    session.tune(spark)
