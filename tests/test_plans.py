"""Iterative plans re-derived with NumPy on the collected sf0.001 tabular stand-in."""
import numpy as np

from lethe.operators import linear as lin
from lethe.operators import rewrite as rw
from lethe.plans import solvers
from lethe.plans import unlearn as ul
from lethe.sources.standins import tabular_samples


def _dense(rows, d):
    X = np.zeros((len(rows), d))
    y = np.zeros(len(rows))
    for n, r in enumerate(rows):
        for i, v in zip(r.idx, r.val):
            X[n, i] = v
        y[n] = r.y
    return X, y


def _np_fit(X, y, lam, iters=50):
    th = np.zeros(X.shape[1])
    for _ in range(iters):
        s = X @ th
        g = X.T @ (-y / (1 + np.exp(y * s))) + lam * th
        p = 1 / (1 + np.exp(-s))
        H = (X * (p * (1 - p))[:, None]).T @ X + lam * np.eye(X.shape[1])
        th = th - np.linalg.solve(H, g)
    return th


def test_newton_and_solvers(spark, sf):
    p = tabular_samples(spark, sf)
    train = p.samples.where("split = 'train'")
    X, y = _dense(train.collect(), p.d)
    th = solvers.fit_newton(train, p.d, 1.0)[None]
    want = _np_fit(X, y, 1.0)
    assert np.allclose(th, want, atol=1e-7)
    assert np.allclose(solvers.fit_lbfgs(train, p.d, 1.0), want, atol=1e-6)
    # second order after removing dims 2, 3 equals theta - H(edited)^-1 G
    delta = rw.removal_delta(train, [2, 3])
    edited = rw.remove_features(train, [2, 3])
    G = ul.change_gradient(delta, th, p.d)
    Xe = X.copy()
    Xe[:, [2, 3]] = 0
    s_new, s_old = Xe @ th, X @ th
    aff = (X[:, [2, 3]] != 0).any(axis=1)
    Gw = (Xe[aff].T @ (-y[aff] / (1 + np.exp(y[aff] * s_new[aff])))) - (X[aff].T @ (-y[aff] / (1 + np.exp(y[aff] * s_old[aff]))))
    assert np.allclose(G, Gw, atol=1e-9)
    He = lin.hessian_matrix(edited, list(th), p.d, 1.0)
    direct = np.linalg.solve(He, G)
    for solver in ("direct", "cg", "lissa"):
        found = ul.inverse_hvp(edited, th, G, p.d, 1.0, solver)
        assert found.converged and found.residual < 1e-9
        assert np.allclose(found.x, direct, rtol=1e-6, atol=1e-6 * np.abs(direct).max())
    values = np.linalg.eigvalsh(He)
    got = solvers.lanczos(lambda v: lin.hvp_vector(edited, list(th), list(v), p.d, 1.0), p.d)
    assert got.converged and np.allclose(got.x, [values[-1], values[0]], rtol=1e-8, atol=1e-6)
    # retraining has the smallest residual, second order beats first order
    res = lambda t: np.linalg.norm(lin.gradient_vector(edited, list(t), p.d, 1.0))
    retr = solvers.fit_newton(edited, p.d, 1.0, theta0=th)[None]
    assert res(retr) < 1e-6
    assert res(ul.second_order(edited, th, G, p.d, 1.0)) <= res(ul.first_order(th, G, 1e-3)) + 1e-12


def test_sharded_fit_equals_per_shard_fit(spark, sf):
    from lethe.operators import sampling as sa
    p = tabular_samples(spark, sf)
    train = p.samples.where("split = 'train'")
    models = ul.sharded_fit(train, 3, p.d, 1.0, seed=1)
    s = sa.assign_shards(train, "row_id", 3, 1).collect()
    for g in range(3):
        X, y = _dense([r for r in s if r.shard == g], p.d)
        assert np.allclose(models[g], _np_fit(X, y, 1.0), atol=1e-7)


def test_solvers_say_when_they_did_not_converge():
    rng = np.random.default_rng(0)
    A = np.diag([1.0, 1e6]) + 0.1
    short = solvers.lissa(lambda v: A @ v, np.ones(2), max_iter=50)
    assert not short.converged and short.residual > 1e-3
    assert not solvers.lissa(lambda v: A @ v, np.ones(2), scale=10.0).converged          # diverges
    B = rng.standard_normal((30, 30))
    B = B @ B.T + np.eye(30)
    v = rng.standard_normal(30)
    assert not solvers.conjugate_gradient(lambda u: B @ u, v, max_iter=3).converged
    full = solvers.conjugate_gradient(lambda u: B @ u, v)
    assert full.converged and np.allclose(full.x, np.linalg.solve(B, v), atol=1e-7)
    assert np.allclose(solvers.lanczos(lambda u: B @ u, 30).x, np.linalg.eigvalsh(B)[[-1, 0]], rtol=1e-7)
    assert np.allclose(solvers.lanczos(lambda u: 2 * u, 5).x, [2, 2])


def test_fits_raise_instead_of_returning_half_done_models(spark, sf):
    import pytest
    p = tabular_samples(spark, sf)
    with pytest.raises(solvers.NotConverged):
        solvers.fit_newton(p.samples, p.d, 1.0, max_iter=1)
    with pytest.raises(solvers.NotConverged):
        solvers.fit_lbfgs(p.samples, p.d, 1.0, max_iter=1)


def test_newton_with_little_regularisation_on_separable_data(spark):
    rows = [(float(1 if k > 0 else -1), [0], [float(k)]) for k in range(-20, 21) if k]
    th = solvers.fit_newton(spark.createDataFrame(rows, "y double, idx array<int>, val array<double>"), 1, 1e-4)[None]
    X = np.array([[r[2][0]] for r in rows])
    y = np.array([r[0] for r in rows])
    assert abs((X.T @ (-y / (1 + np.exp(y * (X @ th)))) + 1e-4 * th)[0]) < 1e-4


def test_empty_shard_has_no_vote(spark):
    rows = [(k, "train", float(1 if k % 2 else -1), [0], [float(1 if k % 2 else -1)]) for k in range(6)]
    df = spark.createDataFrame(rows, "row_id long, split string, y double, idx array<int>, val array<double>")
    models = ul.sharded_fit(df, 40, 1, 1.0)
    assert 1 <= len(models) < 40
    got = {r.row_id: r.vote for r in ul.ensemble_predict(df, models).collect()}
    assert got == {k: float(1 if k % 2 else -1) for k in range(6)}
