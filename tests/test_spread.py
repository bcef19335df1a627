import re

import numpy as np
from pyspark.sql import functions as F

from meterloom import session
from meterloom.operators import complexity
from meterloom.sources import tables


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    """Tasks take a bounded part of a series table, whatever the session's number of partitions; the next query starts anew."""
    spark.range(40_000).selectExpr("id as l_suppkey", "date'2024-01-01' as l_shipdate", "rand(3) as l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(session, "INPUT_BYTES", 10_000)
    before = [spark.conf.get(k, None) for k in (session.INITIAL, session.ADVISORY)]
    tables.table(spark, str(tmp_path), "lineitem")
    assert int(spark.conf.get(session.INITIAL)) > 20 and spark.conf.get(session.ADVISORY) == f"{session.TASK_BYTES}b"
    session.tune(spark)
    assert [spark.conf.get(k, None) for k in (session.INITIAL, session.ADVISORY)] == before


def test_series_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Tasks that make series dense hold a bounded number of the table's rows, however few bytes these take; nothing joins them again."""
    spark.range(4_000).selectExpr("id % 200 as l_suppkey", "date_add(date'2024-01-01', cast(id % 900 as int)) as l_shipdate", "1d as l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    session.tune(spark)
    before = [spark.conf.get(k, None) for k in (session.INITIAL, session.ADVISORY, session.READ)]
    for made in (tables.panel, tables.observed):
        x = made(spark, str(tmp_path))
        n = x.groupBy("series_id", F.spark_partition_id().alias("task")).count().groupBy("task").agg(F.sum("count").alias("rows"))
        assert n.count() > 30 and n.agg(F.max("rows")).first()[0] < x.count() / 10
    assert int(spark.conf.get(session.INITIAL)) >= 40
    session.tune(spark)
    assert [spark.conf.get(k, None) for k in (session.INITIAL, session.ADVISORY, session.READ)] == before


def test_reading_tasks_take_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    """Sums by series and day are begun by tasks of READ_ROWS, not by as many as there are cores or 128 MB."""
    session.tune(spark)
    spark.range(1_500_000).coalesce(1).selectExpr("id as l_suppkey", "date'2024-01-01' as l_shipdate", "rand(3) as l_quantity").write.option("parquet.block.size", 1 << 18) \
        .parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(session, "READ_ROWS", 100_000)
    least = 1_500_000 // 100_000
    t = tables.table(spark, str(tmp_path), "lineitem")
    before = t.rdd.getNumPartitions()
    tables.readings(spark, str(tmp_path))
    assert before < least <= spark.read.parquet(str(tmp_path / "lineitem.parquet")).rdd.getNumPartitions()
    session.tune(spark)
    assert spark.read.parquet(str(tmp_path / "lineitem.parquet")).rdd.getNumPartitions() == before


def test_regularity_sorts_the_dense_rows_once(spark):
    """A task of multiscale_regularity holds one sort of the sparse and one of the dense rows, and no joins of its own branches."""
    from meterloom.operators import panel, profiles

    r = spark.range(300).selectExpr("id % 3 as series_id", "date_add(date'2024-01-01', cast(id as int)) as dt", "cast(id % 7 as double) as value")
    x = panel.densify(r).selectExpr("*", "coalesce(value, 0d) as f")
    out = profiles.multiscale_regularity(x)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 2 and "Join" not in plan
    v = np.array([i % 7 if i % 3 == 1 else 0 for i in range(300)], float)
    got = {r.series_id: r for r in out.collect()}[1]
    high = (v > np.median(v)).astype(int)
    edges = np.flatnonzero(np.r_[True, high[1:] != high[:-1], True])
    lengths, on = np.diff(edges), high[edges[:-1]] == 1

    def entropy(a, bins):
        p = np.histogram(a, bins)[0] / len(a)
        return -(p[p > 0] * np.log(p[p > 0])).sum()

    assert np.allclose([got.entropy_5, got.entropy_10, got.entropy_20, got.run_entropy, got.longest_high_run],
                       [*[entropy(v[v > 0], k) / np.log(k) for k in (5, 10, 20)], entropy(lengths, min(10, len(set(lengths)))), lengths[on].max() / 300])


def _plain(x, m, factor):
    x = np.asarray(x, float)
    x = x - x.mean()
    r2 = (factor * x.std() + 1e-12) ** 2

    def similarity(length):
        t = np.stack([x[j:x.size - length + 1 + j] for j in range(length)], 1)
        s = np.exp(-((t[:, None] - t[None]) ** 2).sum(-1) / r2)
        return max(np.triu(s, 1).sum() * 2 / (len(t) * (len(t) - 1)), 1e-12)

    return np.log(similarity(m)) - np.log(similarity(m + 1))


def test_fuzzy_entropy_takes_one_exponential_for_each_pair(monkeypatch):
    r = np.random.default_rng(5)
    for x in (r.normal(size=200), np.cumsum(r.normal(size=90)), np.ones(40), r.integers(0, 3, size=64), r.normal(size=5)):
        for m in (1, 2, 3):
            assert np.isclose(complexity.fuzzy_entropy_of(x, m), _plain(x, m, 0.15), atol=1e-9)
    taken, exp = [], np.exp
    monkeypatch.setattr(complexity.np, "exp", lambda a, *o, **k: taken.append(a.size) or exp(a, *o, **k))
    complexity.fuzzy_entropy_of(r.normal(size=1000))
    assert sum(taken) < 1.1 * 1000 * 999 / 2


def test_channels_are_not_sorted_one_by_one(spark):
    from meterloom.operators import panel, profiles

    r = spark.range(300).selectExpr("id % 3 as series_id", "date_add(date'2024-01-01', cast(id as int)) as dt", "cast(id as double) as value")
    x = panel.densify(r).selectExpr("*", "coalesce(value, 0d) as f", "cast(is_missing as double) as mask")
    out = profiles.channel_features(x, ["f", "mask"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    base = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == base.count("Exchange")
    assert not re.search(r"windowspecdefinition\(series_id#\d+L?, channel", plan)
    rows = {(r.series_id, r.channel): r for r in out.collect()}
    assert len(rows) == 6
    v = np.array([i if i % 3 == 1 else 0 for i in range(300)], float)
    m = v - v.mean()
    got = rows[1, "f"]
    assert np.allclose([got.mean, got.std, got.median, got.max, got.half_change, got.zero_ratio, got.acov_7],
                       [v.mean(), v.std(), np.median(v), 298, v[150:].mean() - v[:150].mean(), 2 / 3, (m[7:] * m[:-7]).mean() / ((m * m).mean() + 1e-12)])
