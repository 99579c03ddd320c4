"""The model axis against one model after the other in NumPy."""
import numpy as np
import pytest

from lethe.functions.rand import gaussian, gaussian_vector
from lethe.operators.blocks import block_sums, row_chunks
from lethe.operators.sampling import assign_shards, feature_combinations
from lethe.plans import grid as gr

D, LAM = 6, 0.7


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, D)) * (rng.random((400, D)) < 0.6)
    x[:7] = 0
    y = np.where(x @ rng.standard_normal(D) + 0.3 * rng.standard_normal(400) > 0, 1.0, -1.0)
    rows = [(i, float(y[i]), [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, y double, idx array<int>, val array<double>").repartition(5)
    return df, x, y


def plain_fit(x, y, lam, b):
    t = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(y * (x @ t)))
        g = x.T @ (-y * p) + lam * t + b
        if np.linalg.norm(g) < 1e-12:
            break
        t = t - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + lam * np.eye(len(t)), g)
    return t


def plain_grad(x, y, t):
    return x.T @ (-y / (1 + np.exp(y * (x @ t))))


COMBOS = [[0, 1], [2], [3, 4, 5], []]


def keeps():
    keep = np.ones((len(COMBOS), D), bool)
    for k, c in enumerate(COMBOS):
        keep[k, c] = False
    return keep


def test_sums_of_all_models(data):
    df, x, y = data
    rng = np.random.default_rng(2)
    theta, keep, v = rng.standard_normal((4, D)), keeps(), rng.standard_normal((4, D))
    st = gr.grid_stats(df, gr.grid(theta, keep), hessian=True, vectors=v)
    for k in range(4):
        xk = x * keep[k]
        s = xk @ theta[k]
        p = 1 / (1 + np.exp(-s))
        h = (xk * (p * (1 - p))[:, None]).T @ xk
        assert st.n[k] == 400 and st.loss[k] == pytest.approx(np.logaddexp(0, -y * s).sum())
        assert st.accuracy[k] == pytest.approx(np.mean(np.where(s >= 0, 1, -1) == y))
        assert np.allclose(st.grad[k], plain_grad(xk, y, theta[k])) and np.allclose(st.hess[k], h) and np.allclose(st.hv[k], h @ (v[k] * keep[k]))
        pred = np.where(s >= 0, 1, -1)
        f1 = [2 * np.sum((pred == c) & (y == c)) / max(np.sum(pred == c) + np.sum(y == c), 1) for c in (1, -1)]
        assert st.f1()[0][k] == pytest.approx(np.mean(f1)) and st.f1()[1][k] == pytest.approx(np.average(f1, weights=[np.sum(y > 0), np.sum(y < 0)]))


def test_fits_of_a_grid(data):
    df, x, y = data
    lam = [0.5, 5.0, 50.0]
    b = np.array([gaussian_vector(D, f"s{k}", 3.0) for k in range(3)])
    got = gr.fit_grid(df, gr.grid(np.zeros((3, D))), lam, b)
    assert np.allclose(got, [plain_fit(x, y, lam[k], b[k]) for k in range(3)], atol=1e-9)


def test_every_method(data):
    df, x, y = data
    how = gr.Removal(lam=LAM, tau=1e-2, lr=0.1, batches=3, stepsize=1, shards=4, shard_seed=2, batch_seed=6)
    b = np.array(gaussian_vector(D, 4, 0.5))
    keep, got = gr.unlearned(df, COMBOS, D, how, b)
    shard = {r.row_id: r.shard for r in assign_shards(df, "row_id", 4, 2).collect()}
    batch = {r.row_id: r.shard for r in assign_shards(df, "row_id", 3, 6).collect()}
    shard, batch = (np.array([m[i] for i in range(400)]) for m in (shard, batch))
    start = plain_fit(x, y, LAM, b)

    def change(t, before, after):
        hit = ((x != 0) & before & ~after).any(axis=1)
        return plain_grad(x[hit] * after, y[hit], t) * after - plain_grad(x[hit] * before, y[hit], t) * before

    def newton(t, after, g):
        p = 1 / (1 + np.exp(-(x * after) @ t))
        return t - np.linalg.solve(((x * after) * (p * (1 - p))[:, None]).T @ (x * after) + LAM * np.eye(D), g)
    for k, c in enumerate(COMBOS):
        xk, g = x * keep[k], change(start, np.ones(D, bool), keep[k])
        want = {"DP": start, "Occlusion": start, "1st-Order": start - how.tau * g, "2nd-Order": newton(start, keep[k], g), "Retrained": plain_fit(xk, y, LAM, b)}
        one, two, before = start, start, np.ones(D, bool)
        for j in c:
            after = before.copy()
            after[j] = False
            one, two = one - how.tau * change(one, before, after), newton(two, after, change(two, before, after))
            before = after
        want["1st-Order-It"], want["2nd-Order-It"] = one, two
        t = start
        for m in range(3):
            r = batch == m
            t = t - how.lr / r.sum() * (plain_grad(xk[r], y[r], t) + LAM * t + b)
        want["Finetuning"] = t
        for m, w in want.items():
            assert np.allclose(got[m][k], w, atol=1e-8), (m, k)
        calm = ~((x != 0) & ~keep[k]).any(axis=1)
        votes = np.zeros(400)
        for s in range(4):
            r = calm & (shard == s)
            assert np.isnan(got["Sharding"][k, s]).all() if not r.any() else np.allclose(got["Sharding"][k, s], plain_fit(xk[r], y[r], LAM, b), atol=1e-8)
            if r.any():
                votes += np.where(xk @ got["Sharding"][k, s] >= 0, 1, -1)
        acc = gr.accuracies(df, keep, got)
        assert acc["Sharding"][k] == pytest.approx(np.mean(np.where(votes > 0, 1, -1) == y))
        assert acc["Retrained"][k] == pytest.approx(np.mean(np.where(xk @ got["Retrained"][k] >= 0, 1, -1) == y))
        res = gr.residuals(df, keep, {"x": got["1st-Order"]}, LAM, b)["x"][k]
        assert res == pytest.approx(np.linalg.norm(plain_grad(xk, y, got["1st-Order"][k]) + LAM * got["1st-Order"][k] + b))


def test_jobs_do_not_grow_with_the_models(data, spark):
    df, _, _ = data
    sc = spark.sparkContext

    def jobs(n):
        sc.setJobGroup(f"grid{n}", "count")
        gr.change_gradients(df, np.zeros((n, D)), np.ones((n, D), bool), np.zeros((n, D), bool))
        gr.block_influence(df, np.zeros(D), (1.0, np.ones(D)), [[0]] * n, LAM)
        out = len(sc.statusTracker().getJobIdsForGroup(f"grid{n}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        return out
    assert jobs(1) == jobs(40)


def test_block_influence(data):
    df, x, y = data
    t = plain_fit(x, y, LAM, 0)
    x0, y0 = np.linspace(-1, 1, D), -1.0
    p = 1 / (1 + np.exp(-x @ t))
    s = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + LAM * np.eye(D), -y0 / (1 + np.exp(y0 * (x0 @ t))) * x0)
    blocks = [[0], [1, 2], [3, 4, 5], [0, 5]]
    got = gr.block_influence(df, t, (y0, x0), blocks, LAM)
    for k, c in enumerate(blocks):
        keep = np.ones(D, bool)
        keep[c] = False
        hit = (x[:, c] != 0).any(axis=1)
        g = plain_grad(x[hit] * keep, y[hit], t) * keep - plain_grad(x[hit], y[hit], t)
        # the gradient without the block has no part in the block's columns, whatever s is there
        assert got[k] == pytest.approx(g @ s / 400, rel=1e-9)


def test_empty_rows(data):
    df, _, _ = data
    none = df.where("row_id < 0")
    assert gr.grid_stats(none, gr.grid(np.ones((2, D)))).n.tolist() == [0, 0]
    assert np.isnan(gr.fit_grid(none, gr.grid(np.zeros((2, D))), LAM)).all()
    assert not gr.change_gradients(none, np.ones((1, D)), np.ones((1, D), bool), np.zeros((1, D), bool)).any()


def test_blocks_add_up(spark):
    df = spark.range(1000).selectExpr("id", "array(int(id % 7)) AS idx", "array(double(id)) AS val").repartition(9)

    def partial(batches):
        out = {}
        for _, x in row_chunks(batches, 1, limit=100):
            for c, v in zip(x.col, x.val):
                out[int(c)] = out.get(int(c), np.zeros(2)) + [1, v]
        return out
    got = block_sums(df.select("idx", "val"), partial)
    assert {k: v.tolist() for k, v in got.items()} == {k: [len(range(k, 1000, 7)), sum(range(k, 1000, 7))] for k in range(7)}


def test_gaussian_draws(spark):
    got = [r.z for r in spark.range(20_000).select(gaussian("id", 3).alias("z")).collect()]
    assert np.allclose(got[:50], gaussian_vector(50, 3))
    assert abs(np.mean(got)) < 0.03 and abs(np.std(got) - 1) < 0.02 and abs(np.mean(np.power(got, 3))) < 0.1 and abs(np.mean(np.power(got, 4)) - 3) < 0.25
    assert abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < 0.03


def test_combinations_are_distinct_dims(spark):
    rows = feature_combinations(spark, 9, 5, 4, 2).collect()
    for c in range(5):
        assert len({r.dim for r in rows if r.combo_id == c}) == 4 == sum(r.combo_id == c for r in rows)
