import numpy as np

from meterloom.operators import peers


def test_singular_values_of_an_ill_conditioned_panel(spark):
    """Values down to 10^-6 of the largest, whose squares a Gram matrix would hold to two digits."""
    r = np.random.default_rng(7)
    u, _ = np.linalg.qr(r.normal(size=(400, 12)))
    v, _ = np.linalg.qr(r.normal(size=(12, 12)))
    s = 10.0 ** -np.linspace(0, 6, 12)
    x = (u * s) @ v.T
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "series_id long, x array<double>").repartition(7)
    got = np.linalg.svd(peers.triangular_factor(df), compute_uv=False)
    assert np.allclose(got, s, rtol=1e-8, atol=0)
    top = peers.right_vectors(df, 5)
    assert np.allclose(np.abs((top * v[:, :5]).sum(0)), 1, atol=1e-9)
    res = peers.low_rank_residual(df, top).collect()
    want = x - x @ v[:, :5] @ v[:, :5].T
    assert max(np.abs(np.array(row.residual) - want[row.series_id]).max() for row in res) < 1e-12


def test_fewer_rows_than_days(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [0.0, 1.0, 0.0, 1.0])], "series_id long, x array<double>")
    assert np.allclose(np.linalg.svd(peers.triangular_factor(df), compute_uv=False), np.linalg.svd(np.array([[1.0, 2, 3, 4], [0, 1, 0, 1]]), compute_uv=False))
    assert peers.triangular_factor(df.limit(0)).size == 0
