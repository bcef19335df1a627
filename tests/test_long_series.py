"""Counting over long series, against the plain definitions."""
import numpy as np
import pytest

from meterloom.operators import complexity, peaks, sampling


def close_pairs(x, length, r):
    k = x.size - length
    t = np.stack([x[j:j + k] for j in range(length)], 1)
    return sum(int((np.abs(t[i + 1:] - t[i]).max(1) < r).sum()) for i in range(k))


@pytest.mark.parametrize("length", [1, 2, 3])
def test_template_pairs(length, monkeypatch):
    r = np.random.default_rng(length)
    for limit in (1 << 22, 50):
        monkeypatch.setattr(complexity, "PAIRS", limit)
        for x in (r.normal(size=300), np.round(r.normal(size=400), 1), np.r_[np.zeros(150), r.random(80)], np.cumsum(r.normal(size=200)), np.arange(5.0)):
            assert complexity._matches(x, length, 0.2 * x.std()) == close_pairs(x, length, 0.2 * x.std())


def test_sample_entropy_of_a_long_series_ends():
    r = np.random.default_rng(1)
    assert 2.1 < complexity.sample_entropy_of(r.normal(size=100_000)) < 2.3
    assert complexity.sample_entropy_of(np.r_[np.zeros(60_000), r.normal(size=20_000)]) > 0


def test_phrases_are_those_of_the_definition():
    r = np.random.default_rng(2)
    for _ in range(200):
        s = r.integers(0, r.integers(1, 5), r.integers(1, 60))
        text, count, at = "".join(map(chr, 97 + s)), 0, 0
        while at < len(text):
            size = 1
            while at + size <= len(text) and text[at:at + size] in text[:at + size - 1]:
                size += 1
            count, at = count + 1, at + size
        assert complexity.count_phrases(s, 5) == count
    assert complexity.count_phrases(r.integers(0, 5, 300_000), 5) > 1000 and complexity.count_phrases(np.zeros(300_000, int), 5) == 2


def test_peaks_match_greedy_suppression(spark):
    r = np.random.default_rng(3)
    series = {i: r.integers(0, 6, 150).astype(float) for i in range(6)} | {9: np.r_[np.arange(60.0), np.arange(60.0)[::-1]]}
    df = spark.createDataFrame([(i, k, float(v)) for i, x in series.items() for k, v in enumerate(x)], "series_id long, pos int, value double")
    got = {}
    for row in peaks.local_peaks(df, distance=7).collect():
        got.setdefault((row.series_id, row.side), []).append(row.at)
    for i, x in series.items():
        for side in (1, -1):
            v, top, k = side * x, [], 1
            while k < len(v) - 1:
                z = k
                while z + 1 < len(v) and v[z + 1] == v[k]:
                    z += 1
                if v[k] > v[k - 1] and z + 1 < len(v) and v[k] > v[z + 1]:
                    top.append((v[k], (k + z) // 2))
                k = z + 1
            kept = []
            for _, at in sorted(top, reverse=True):
                if all(abs(at - o) >= 7 for o in kept):
                    kept.append(at)
            assert sorted(got.get((i, side), [])) == sorted(kept), (i, side)


def test_balancing_inside_training_parts(spark):
    r = np.random.default_rng(6)
    rows = [(int(i) * (-3 if i % 2 else 5), int(i % 7 == 0), int(i % 3), [float(x) for x in np.round(r.normal(size=3), 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, vec array<double>")
    by = {i: (y, f, np.array(v)) for i, y, f, v in rows}
    made = sampling.smote_by_fold(df, 3).collect()
    for f in range(3):
        own = [m for m in made if m.without == f]
        assert all(by[m.id][1] != f and (m.partner is None or by[m.partner][1] != f) for m in own)
        assert sum(m.y for m in own) * 2 == len(own) and len({(m.id, m.copy) for m in own}) == len(own)
        small = {i: v for i, (y, g, v) in by.items() if y == 1 and g != f}
        for m in own:
            if m.copy:
                near = sorted((float(np.linalg.norm(v - small[m.id])), i) for i, v in small.items() if i != m.id)[:5]
                assert m.partner in {i for _, i in near}
                a, b, x = small[m.id], small[m.partner], np.array(m.vec)
                t = np.dot(x - a, b - a) / np.dot(b - a, b - a)
                assert 0 <= t < 1 and np.allclose(a + t * (b - a), x)
    left = sampling.balanced_folds(df, 3).collect()
    kept = {(m.without, m.id, m.copy) for m in left}
    for f in range(3):
        own = [m for m in made if m.without == f]
        x = np.array([m.vec for m in own])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        near = d.argmin(1)
        gone = {k for k in range(len(own)) if near[near[k]] == k and own[k].y != own[near[k]].y}
        assert {(f, m.id, m.copy) for k, m in enumerate(own) if k not in gone} == {x for x in kept if x[0] == f}
