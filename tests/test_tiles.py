import numpy as np
import pytest

from meterloom.operators import neighbours, sampling


def test_a_row_is_sent_to_few_tiles():
    """Not to as many as there are cells, whose number grows with the input."""
    for n in (2_000, 100_000, 600_000):
        groups, shards = neighbours._tiles(n, n, 64)
        assert groups + shards <= 20
        assert groups * neighbours.TILE_BYTES >= n * 64 * 8 and groups * shards <= max(64, 100)


@pytest.mark.parametrize("spread", [1.0, 0.01])
def test_neighbours_over_many_tiles(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "SLAB_ROWS", 40)
    monkeypatch.setattr(neighbours, "TILE_BYTES", 8 * 3 * 50)
    monkeypatch.setattr(neighbours, "TILE_PAIRS", 1 << 10)
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(400, 3)) * spread + r.integers(0, 4, size=(400, 1)) * 5, 2)
    x[100:160] = x[100]  # a clump of copies: ties by id
    ids = r.permutation(4000)[:400] - 2000
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "id long, vec array<double>").repartition(5)
    some = df.where("id % 3 = 0")
    got = {}
    for row in neighbours.nearest_neighbours(some, df, 6).collect():
        got.setdefault(row.id, {})[row["rank"]] = (row.nid, row.dist)
    assert sorted(got) == sorted(int(i) for i in ids if i % 3 == 0)
    for i, near in got.items():
        d = np.sqrt(((x - x[list(ids).index(i)]) ** 2).sum(1))
        want = sorted((float(d[j]), int(n)) for j, n in enumerate(ids) if n != i)[:6]
        assert [near[k + 1] for k in range(6)] == [(n, w) for w, n in want]


def test_tomek_links_of_copies(spark):
    rows = [(1, 0, [0.0]), (2, 1, [0.0]), (3, 1, [5.0]), (4, 1, [6.0]), (5, 0, [9.0])]
    df = spark.createDataFrame(rows, "id long, y int, vec array<double>")
    assert sorted(r.id for r in sampling.remove_tomek_links(df).collect()) == [3, 4, 5]
