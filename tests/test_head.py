"""Second-order work on the softmax head against dense NumPy solves."""
import numpy as np
import pytest

from lethe.plans import head

N, K, D = 300, 4, 5


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((N, D))
    label = np.argmax(x @ rng.standard_normal((D, K)) + 0.2 * rng.standard_normal((N, K)), axis=1)
    df = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(N)], "row_id long, label int, x array<double>").repartition(4)
    return df, x, label, rng.standard_normal((K, D))


def probs(x, W):
    z = x @ W.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def dense_hessian(x, W):
    p = probs(x, W)
    h = np.zeros((K * D, K * D))
    for xi, pi in zip(x, p):
        h += np.kron(np.diag(pi) - np.outer(pi, pi), np.outer(xi, xi))
    return h


def test_products_and_gradient(data):
    df, x, label, W = data
    V = np.random.default_rng(1).standard_normal((K, D))
    assert np.allclose(head.head_hvp(df, W, V).ravel(), dense_hessian(x, W) @ V.ravel())
    n, g = head.head_gradient(df, W)
    p = probs(x, W)
    p[np.arange(N), label] -= 1
    assert n == N and np.allclose(g, p.T @ x)
    none = df.where("row_id < 0")
    assert head.head_gradient(none, W)[0] == 0 and not head.head_hvp(none, W, V).any()


def test_solve_against_dense(data):
    df, x, _, W = data
    G = np.random.default_rng(2).standard_normal((K, D))
    got = head.head_solve(df, W, G, 0.5)
    want = np.linalg.solve(dense_hessian(x, W) + 0.5 * np.eye(K * D), G.ravel())
    assert got.converged and np.allclose(got.x.ravel(), want, atol=1e-8)
    assert np.allclose(head.update(df, W, G, 0.0, head.Second(0.5))[0], W - got.x)
    assert head.update(df, W, np.zeros((K, D)), 0.1, head.Second(0.5)) == (pytest.approx(W), False)


def test_lissa_agrees_with_the_solve(data):
    df, x, _, W = data
    G = np.random.default_rng(3).standard_normal((K, D))
    H = dense_hessian(x, W)
    scale = 1.5 * np.linalg.eigvalsh(H)[-1]
    want = np.linalg.solve(H + 0.4 * scale * np.eye(K * D), G.ravel())
    one = head.head_lissa(df, W, G, 1, scale, 0.4, iterations=25)
    assert not one.diverged and np.allclose(one.x.ravel(), want, rtol=1e-4, atol=1e-7)
    some = head.head_lissa(df, W, G, 3, scale, 0.4, iterations=12, rounds=2, patience=1000, seed=5)
    assert not some.diverged and np.linalg.norm(some.x.ravel() - want) < 0.15 * np.linalg.norm(want)
    assert len(some.steps) == 2 and all(len(s) == 12 for s in some.steps)
    bad = head.head_lissa(df, W, G, 1, scale / 50, 0.0, iterations=20, patience=5)
    assert bad.diverged
    W2, diverged = head.update(df, W, G, 0.0, head.Second(0.0, "lissa", scale / 50, iterations=20, patience=5))
    assert diverged and (W2 == W).all()


def test_rounds_follow_the_recursion():
    rng = np.random.default_rng(4)
    H = [np.diag(rng.random(3)) for _ in range(6)]
    v = rng.standard_normal(3)
    got = head.lissa_rounds(lambda r, b, u: H[3 * r + b] @ u, v, 3, 2.0, 0.1, iterations=7, rounds=2)
    want = []
    for r in range(2):
        u = v
        for i in range(7):
            u = v + 0.9 * u - H[3 * r + i % 3] @ u / 2.0
        want.append(u / 2.0)
    assert np.allclose(got.x, np.mean(want, axis=0)) and not got.diverged


def test_draws_with_replacement(data, spark):
    df, _, _, _ = data
    got = head.draw_rows(df.where("row_id < 10").select("row_id"), 2000, 3).collect()
    assert sorted(r.draw for r in got) == list(range(2000)) and {r.row_id for r in got} == set(range(10))
    counts = np.bincount([r.row_id for r in got])
    assert abs(counts - 200).max() < 70
    assert head.draw_rows(df.where("row_id < 0").select("row_id"), 5, 3).count() == 0


def test_sgd_against_numpy(data):
    df, x, label, W = data
    ids = {r.row_id: r.deal for r in head.dealt(df.select("row_id"), 3, 2, 9).collect()}
    want = W
    for epoch in range(2):
        for b in range(3):
            rows = np.array([i for i in range(N) if ids[i][epoch] == b])
            p = probs(x[rows], want)
            p[np.arange(len(rows)), label[rows]] -= 1
            want = want - 0.3 * p.T @ x[rows] / len(rows)
    assert np.allclose(head.sgd(df, W, 0.3, 3, 2, 9), want)


def test_unlearning_repairs_wrong_labels(data, spark):
    from pyspark.sql import functions as F
    df, x, label, W = data
    clean = head.sgd(df, np.zeros((K, D)), 0.8, 1, 20, 0)
    wrong = df.withColumn("label", F.when(F.col("row_id") < 60, (F.col("label") + 1) % K).otherwise(F.col("label")))
    poisoned = head.sgd(wrong, np.zeros((K, D)), 0.8, 1, 20, 0)
    train = df.join(wrong.where("row_id < 60").select("row_id", F.col("label").alias("old_label")), "row_id", "left")
    right = lambda V: np.mean(np.argmax(x @ V.T, axis=1) == label)
    W2, log = head.unlearn_steps(train, df, poisoned, 2, 1, second=head.Second(5.0), ratio=0.5)
    assert right(W2) > right(poisoned) and len(log) == 2
    W3, log = head.unlearn_steps(train, df, poisoned, 2, 1, second=head.Second(5.0), batch=40)
    assert right(W3) > right(poisoned)
    assert log[-1]["delta_size"] == np.sum(np.argmax(x @ W3.T, axis=1) != label) == log[-1]["new_errors"] + log[-1]["remaining"]
    assert right(clean) >= right(W3) - 0.1
    with pytest.raises(ValueError):
        head.unlearn_steps(train, df, poisoned, 1, 1)
