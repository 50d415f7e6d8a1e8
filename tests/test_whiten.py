"""Whitening: invariants, and sources that ICA must find."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import whiten as wh


def frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id bigint, vec array<double>").repartition(4)


def rows(df):
    return np.array([r["vec"] for r in df.orderBy("doc_id").collect()])


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(0)
    s = rng.laplace(size=(3000, 4))
    return s, frame(spark, s @ rng.standard_normal((4, 4)) + 3.0)


@pytest.mark.parametrize("fit", [wh.zca_fit, lambda v: wh.pca_whiten_fit(v, n_components=4), lambda v: wh.ica_fit(v, n_components=4)])
def test_output_is_white(mixed, fit):
    _, cov, _ = wh.covariance(wh.transform(fit(mixed[1]), mixed[1]))
    assert np.allclose(cov, np.eye(4), atol=1e-5)


def test_ica_finds_the_sources(mixed):
    s, x = mixed
    found = rows(wh.transform(wh.ica_fit(x, n_components=4), x))
    c = np.abs(np.corrcoef(s.T, found.T)[:4, 4:])
    assert (c.max(axis=1) > 0.98).all()


def test_components_by_share(spark):
    rng = np.random.default_rng(1)
    x = frame(spark, rng.standard_normal((500, 5)) * np.array([10, 5, 1, 0.1, 0.01]))
    model, share = wh.pca_fit(x, n_components=0.96)
    assert share.sum() > 0.96 and share[:-1].sum() <= 0.96
    low = wh.transform(wh.pca_zca_fit(x, n_components=0.96), x)
    assert rows(low).shape == (500, 5)
    assert np.linalg.matrix_rank(np.cov(rows(low).T), tol=1e-6) == len(share)


def test_model_as_table(spark, mixed):
    model = wh.zca_fit(mixed[1])
    back = wh.LinearModel.from_frame(model.to_frame(spark))
    assert np.array_equal(back.matrix, model.matrix) and np.array_equal(back.mean, model.mean)


def test_permutation_over_several_blocks(spark):
    x = np.random.default_rng(2).standard_normal((9000, 3))
    out = rows(wh.permute_columns(frame(spark, x), share_rows=500))
    assert np.array_equal(out, rows(wh.permute_columns(frame(spark, x))))  # shares only change the work
    assert np.array_equal(np.sort(out, axis=0), np.sort(x, axis=0))
    assert (out == x).mean() < 0.01
    assert abs(np.corrcoef(out[:, 0], out[:, 1])[0, 1]) < 0.05


def test_correlation_is_clipped(spark):
    base = np.random.default_rng(3).standard_normal((200, 1))
    c = wh.corr_matrix(frame(spark, np.hstack([base, base * 2, -base])))
    assert c.agg(F.max("corr"), F.min("corr")).first()[0] <= 1.0
    assert c.where("i = 1 and j = 3").first()["corr"] == pytest.approx(-1.0)


def test_covariance_far_from_the_origin(spark):
    """Digits of the variance survive any offset; an uncentred sum of squares would lose them all."""
    x = np.random.default_rng(4).standard_normal((500, 3)) * 1e-2
    for offset in (0.0, 1e6, -1e8):
        far = x + offset
        mean, cov, n = wh.covariance(frame(spark, far))
        assert n == 500 and np.allclose(mean, far.mean(axis=0), rtol=1e-12)
        assert np.allclose(cov, np.cov(far.T), rtol=1e-6, atol=1e-10)
        cells = {(r["i"], r["j"]): r["cov"] for r in wh.cov_matrix(frame(spark, far)).collect()}
        assert all(abs(cells[i + 1, j + 1] - cov[i, j]) < 1e-12 for i in range(3) for j in range(3))


def test_permutation_changes_every_dimension(spark):
    """A column's values stay, their places do not, and the dimensions move on their own."""
    x = np.random.default_rng(5).standard_normal((400, 4))
    out = rows(wh.permute_columns(frame(spark, x)))
    assert np.array_equal(np.sort(out, axis=0), np.sort(x, axis=0))
    row_of = [{v: i for i, v in enumerate(x[:, d])} for d in range(4)]
    places = [np.array([row_of[d][v] for v in out[:, d]]) for d in range(4)]
    assert all((out[:, d] != x[:, d]).mean() > 0.9 for d in range(4))
    assert all((places[a] == places[b]).mean() < 0.1 for a in range(4) for b in range(a))


def test_combined_steps_reach_the_same_fixed_point(spark):
    """A plain iteration in numpy, many passes, against the combined one; a fit cut short says so."""
    rng = np.random.default_rng(6)
    x = rng.laplace(size=(800, 5)) @ rng.standard_normal((5, 5))
    table = frame(spark, x)
    model = wh.ica_fit(table, n_components=5, tol=1e-9)
    assert model.converged
    white = wh.pca_whiten_fit(table, n_components=5)
    z, w = (x - white.mean) @ white.matrix.T, wh._decorrelate(np.random.default_rng(0).standard_normal((5, 5)))
    for _ in range(500):
        g = np.tanh(z @ w.T)
        w = wh._decorrelate(g.T @ z / len(z) - (1 - g * g).mean(0)[:, None] * w)
    match = np.abs((w @ white.matrix) @ np.linalg.pinv(model.matrix))
    assert np.allclose(np.sort(match, axis=1)[:, -1], 1, atol=1e-3) and np.allclose(np.sort(match, axis=1)[:, :-1], 0, atol=1e-2)
    with pytest.warns(UserWarning):
        assert not wh.ica_fit(table, n_components=5, max_iter=1).converged
