"""Label-noise plans over the whole train split against NumPy."""
import numpy as np

from lethe.plans import noise

K, D = 3, 4


def _rows(rng, n):
    return [(i, int(rng.integers(K)), [float(v) for v in rng.normal(size=D)], i % 9 == 0) for i in range(n)]


def test_unlearning_counts_and_picks_rows_outside_the_change_set(spark):
    rng = np.random.default_rng(3)
    rows, held = _rows(rng, 120), _rows(rng, 40)
    W0 = rng.normal(size=(K, D))
    schema = "row_id long, label int, x array<double>, flipped boolean"
    train = spark.createDataFrame([(i, y, x, True if f else None) for i, y, x, f in rows], schema).repartition(3)
    valid = spark.createDataFrame(held, schema)
    every = len(rows)                                       # a batch of all wrong rows needs no hash order
    W, log = noise.unlearn_train_noise(train, valid, W0, 0.01, every, 3, 5)
    X, y, f = np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    Xv, yv = np.array([r[2] for r in held]), np.array([r[1] for r in held])
    V = W0.copy()
    for step in range(3):
        pred = (X @ V.T).argmax(axis=1)
        bad = pred != y
        assert (bad & ~f).sum() > 10
        for x, p, t in zip(X[bad], pred[bad], y[bad]):
            V[p] -= 0.01 * x
            V[t] += 0.01 * x
        now = (X @ V.T).argmax(axis=1) != y
        got = log[step]
        assert (got["delta_size"], got["new_errors"], got["remaining"]) == (now.sum(), (now & ~f).sum(), (now & f).sum())
        assert np.isclose(got["batch_accuracy"], 1 - now[bad].mean())
        assert np.isclose(got["valid_accuracy"], ((Xv @ V.T).argmax(axis=1) == yv).mean())
    assert np.allclose(W, V) and len(log) == 3


def test_unlearning_stops_when_no_row_is_wrong(spark):
    rng = np.random.default_rng(4)
    W0 = rng.normal(size=(K, D))
    rows = [(i, int((W0 @ x).argmax()), [float(v) for v in x], False) for i, x in enumerate(rng.normal(size=(20, D)))]
    train = spark.createDataFrame(rows, "row_id long, label int, x array<double>, flipped boolean")
    W, log = noise.unlearn_train_noise(train, train, W0, 0.01, 8, 3, 5)
    assert np.array_equal(W, W0) and log == []


def test_fine_tuning_sees_every_train_row(spark, sf):
    from lethe.queries import q_noise as q
    rows = q._img(spark, sf).where("split = 'train'").select("label", "x").collect()
    X, y = np.array([r.x for r in rows], float), np.array([r.label for r in rows])
    W = np.array(q.W0, float)
    for _ in range(q.TUNE_EPOCHS):
        z = X @ W.T
        P = np.exp(z - z.max(axis=1, keepdims=True))
        P /= P.sum(axis=1, keepdims=True)
        P[np.arange(len(y)), y] -= 1
        W = W - q.TUNE_RATE * P.T @ X / len(y)
    got = q.m9_fine_tune_train(spark, sf).collect()
    assert len(rows) > 40 and len(got) == W.size
    assert all(abs(r.w - W[r.cls, r.dim]) < 2e-6 for r in got)
