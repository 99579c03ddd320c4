"""Variants of rewriting, triggers, summaries, text heads and stored artefacts against plain Python."""
import math
from collections import Counter

import numpy as np
import pytest

from lethe.operators import features as fe
from lethe.operators import memorize as mz
from lethe.operators import metrics as me
from lethe.operators import rewrite as rw
from lethe.operators import triggers as tg
from lethe.operators.sampling import choose_rows
from lethe.operators.summary import data_summary
from lethe.plans import text_head as th
from lethe.sources import store
from lethe.sources.standins import Prepared

SAMPLES = "row_id long, split string, y double, idx array<int>, val array<double>"


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        x = np.round(rng.standard_normal(4), 3) * (rng.random(4) < 0.7)
        rows.append((i, "train" if i % 5 else "test", float(rng.choice([-1, 1])), [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[x != 0]]))
    return spark.createDataFrame(rows, SAMPLES).repartition(3), rows


def value(row, j):
    return dict(zip(row.idx, row.val)).get(j, 0.0)


def test_draws_keep_the_multiset(samples):
    df, _ = samples
    before = {r.row_id: r for r in df.collect()}
    for within in (True, False):
        after = {r.row_id: r for r in rw.draw_values(df, [1, 3], 20, 5, within=within).collect()}
        chosen = {r.row_id for r in choose_rows(df.select("row_id"), "row_id", 20, 5).collect()}
        assert after.keys() == before.keys() and len(chosen) == 20
        for i in before:
            assert all(value(after[i], j) == value(before[i], j) for j in ((0, 2) if i in chosen else range(4)))
            assert list(after[i].idx) == sorted(after[i].idx) and 0.0 not in after[i].val
        for j in (1, 3):
            drawn = Counter(value(after[i], j) for i in chosen)
            pool = Counter(value(before[i], j) for i in (chosen if within else before))
            assert drawn == pool if within else not drawn - pool
    assert rw.draw_values(df, [0], 500, 1, within=True).count() == 60


def test_change_sets_by_rows_and_tuples(samples, spark):
    df, rows = samples
    new = spark.createDataFrame([(3, [0, 2], [9.0, 8.0], 1.0), (7, [], [], None)], "row_id long, idx array<int>, val array<double>, y double")
    got = {r.row_id: r for r in rw.rows_delta(df, new, 4).collect()}
    assert got[3].y_delta == 1.0 and got[7].y_delta == rows[7][2] and got[7].idx_delta == [] and got[3].idx == rows[3][3]
    for bad in ([(3, [4], [1.0])], [(3, [0], [1.0, 2.0])], [(3, [0], [1.0]), (3, [1], [1.0])], [(1000, [0], [1.0])], [(3, None, [1.0])]):
        with pytest.raises(ValueError):
            rw.rows_delta(df, spark.createDataFrame(bad, "row_id long, idx array<int>, val array<double>"), 4)
    old = spark.createDataFrame([(1, 1.0, [0], [1.0])], "row_id long, y double, idx array<int>, val array<double>")
    edit = spark.createDataFrame([(1, None, [1], [2.0])], "row_id long, y double, idx array<int>, val array<double>")
    (r,) = rw.tuples_delta(old, edit).collect()
    assert (r.y, r.y_delta, r.idx, r.idx_delta) == (1.0, 1.0, [0], [1])


def test_triggers(spark):
    rows = [(i, i % 3, [0.25] * 64) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, label int, x array<double>")
    pattern = tg.preset("cross", 8, 8, 1)
    cells = {k for k, v in enumerate(df.limit(1).select(tg.stamp("x", pattern).alias("x")).first().x) if v != 0.25}
    assert cells == {5 * 8 + 5, 5 * 8 + 7, 6 * 8 + 6, 7 * 8 + 5, 7 * 8 + 7}
    hit, kept = tg.inject(df, pattern, 4, 0, 2, 9)
    assert Counter(r.label for r in hit.collect()) == {0: 6, 1: 10, 2: 14} and kept.count() == 4
    assert sorted(map(tuple, tg.restore(hit, kept).collect())) == sorted((i, c, x) for i, c, x in rows)
    part = tg.restore(hit, kept, kept.limit(1))
    assert Counter(r.label for r in part.collect()) == {0: 7, 1: 10, 2: 13}
    every, all_kept = tg.inject(df, pattern, -1, -1, 2, 9, keep_labels=True)
    assert all_kept.count() == 20 and Counter(r.label for r in every.collect()) == {0: 10, 1: 10, 2: 10}
    assert sum(r.x != [0.25] * 64 for r in every.collect()) == 20
    for bad in (lambda: tg.inject(df, pattern, 1, 2, 2, 9), lambda: tg.preset("star", 8, 8, 1), lambda: tg.preset("cross-centered-large", 8, 8, 1)):
        with pytest.raises(ValueError):
            bad()
    noise = df.limit(1).select(tg.stamp("x", tg.preset("noise", 8, 8, 1)).alias("x")).first().x
    assert all(0.25 <= v < 0.35 for v in noise) and len(set(noise)) > 50


def test_early_stop(spark):
    losses = {"a": [5, 4, 3, 3, 3, 2], "b": [1, 2, 3], "c": [3, 2, 1], "d": [2, 3, 1, 4, 5, 6]}
    log = spark.createDataFrame([(r, e, float(v)) for r, vs in losses.items() for e, v in enumerate(vs)], "run string, epoch int, loss double")
    got = {r.run: (r.stop_epoch, r.least) for r in me.early_stop(log, 2).collect()}
    assert got == {"a": (4, 3.0), "b": (2, 1.0), "c": (2, 1.0), "d": (4, 1.0)}


def test_codes_of_texts(spark):
    docs = spark.createDataFrame([(1, "abca"), (2, ""), (3, None), (4, "a?\U0001f600")], "doc_id long, text string")
    vocab = fe.char_vocab(docs.where("doc_id = 1"))
    out = {r.doc_id: r for r in fe.decode_text(fe.encode_text(docs, vocab), vocab, name="back").collect()}
    assert out[1].codes == [0, 1, 2, 0] and out[1].back == "abca" and out[2].back == "" and out[3].codes is None
    assert out[4].codes == [0, None, None] and out[4].back == "a��"


def test_summary_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, 5, "x", 1), (2.0, 5, None, 1), (float("nan"), 5, "x", 0), (None, 5, "x", 0), (11.0, 5, "y", 1)], "a double, b int, c string, label int")
    got = {(r.column, r.bucket, r.label): r.n for r in data_summary(df, "label", bins=10).collect()}
    assert got == {("a", "1", 1): 1, ("a", "2", 1): 1, ("a", "NaN", 0): 1, ("a", None, 0): 1, ("a", "10", 1): 1, ("b", "1", 1): 3, ("b", "1", 0): 2,
                   ("c", "x", 1): 1, ("c", None, 1): 1, ("c", "x", 0): 2, ("c", "y", 1): 1}
    assert data_summary(df.limit(0), "label").collect() == []


def test_skew_normal_against_erf(spark):
    rng = np.random.default_rng(3)
    for sample in (rng.gamma(4.0, 2.0, 4000), -rng.gamma(4.0, 2.0, 4000), rng.standard_normal(4000)):
        dist = spark.createDataFrame([(float(v),) for v in sample], "pp double")
        fit = mz.skewnorm_fit(dist).first()
        xs = [float(np.quantile(sample, q)) for q in (0.001, 0.1, 0.5, 0.9)]
        got = {r.pp: r for r in mz.skewnorm_exposure(dist, spark.createDataFrame([(x,) for x in xs], "pp double")).collect()}
        d = fit.alpha / math.sqrt(1 + fit.alpha ** 2)
        assert fit.xi + fit.omega * d * math.sqrt(2 / math.pi) == pytest.approx(sample.mean(), rel=1e-9, abs=1e-9)
        assert fit.omega ** 2 * (1 - 2 * d * d / math.pi) == pytest.approx(sample.var(), rel=1e-9)
        for x in xs:
            t = np.linspace(-14, (x - fit.xi) / fit.omega, 200_001)
            cdf = np.trapezoid(2 * np.exp(-t * t / 2) / math.sqrt(2 * math.pi) * 0.5 * (1 + np.array([math.erf(v) for v in fit.alpha * t / math.sqrt(2)])), t)
            assert got[x].cdf == pytest.approx(cdf, rel=1e-6, abs=1e-12)
            if cdf > 1e-9:                       # below it 1 + erf has no digits left
                assert got[x].exposure == pytest.approx(-math.log2(cdf), abs=1e-5)
    flat = spark.createDataFrame([(2.0,)] * 5, "pp double")
    steps = {r.pp: r.cdf for r in mz.skewnorm_exposure(flat, spark.createDataFrame([(1.0,), (2.0,)], "pp double")).collect()}
    assert steps == {1.0: 0.0, 2.0: 1.0}


def test_sampled_text_leaves_out_the_likeliest_first(spark):
    texts = spark.createDataFrame([(1, "ab" * 30 + "ac" * 20 + "ad" * 10)], "doc_id long, text string")
    counts = mz.kgram_counts(texts, 1)
    starts = spark.createDataFrame([(i, "xa") for i in range(300)] + [(1000, "zz")], "sid long, start string")
    got = {r.sid: r.gen for r in mz.sampled_continue(starts, counts, 1, 2, 2, 7, "a").collect()}
    assert {g[0] for s, g in got.items() if s < 300} == {"c", "d"} and all(g[1] == "a" for s, g in got.items() if s < 300)
    assert got[1000][0] == "a" and got[1000][1] in "bc"
    two = Counter(r.gen[0] for r in mz.sampled_continue(starts.where("sid < 300"), counts, 1, 1, 2, 7, "a", weighted=True).collect())
    assert 1.2 < two["c"] / two["d"] < 3.2


def dense_text(counts, alphabet, W):
    """(windows, loss, gradient, Hessian) with one row a window count."""
    V, k = len(alphabet.chars), alphabet.k
    code = {c: i for i, c in enumerate(alphabet.chars)}
    n_all, loss, grad, hess = 0, 0.0, np.zeros(W.size), np.zeros((W.size, W.size))
    for ctx, nx, n in counts:
        f = np.zeros(k * V)
        for j, c in enumerate(ctx):
            if c in code:
                f[j * V + code[c]] = 1
        z = W @ f
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if nx in code:
            n_all += n
            loss -= n * math.log(p[code[nx]])
            grad += n * np.outer(p - np.eye(V)[code[nx]], f).ravel()
            hess += n * np.kron(np.diag(p) - np.outer(p, p), np.outer(f, f))
    return n_all, loss, grad, hess


def test_text_head_against_dense(spark):
    old = spark.createDataFrame([(1, "the secret is 42 and more"), (2, "the other text")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "the secret is xx and more"), (2, "the other text")], "doc_id long, text string")
    counts = mz.kgram_counts(old, 2)
    alphabet = th.Alphabet(tuple(sorted(set("the secret is 42 and more other text") - {"4"})), 2)
    W = np.random.default_rng(1).standard_normal(alphabet.shape) / 3
    rows = th.context_rows(counts)
    n, loss, grad = th.text_sums(rows, alphabet, W)
    table = [tuple(r) for r in counts.collect()]
    want = dense_text(table, alphabet, W)
    assert n == want[0] and loss == pytest.approx(want[1]) and np.allclose(grad.ravel(), want[2])
    v = np.random.default_rng(2).standard_normal(W.shape)
    assert np.allclose(th.text_sums(rows, alphabet, W, v)[2].ravel(), want[3] @ v.ravel())
    assert np.allclose(th.train_text(rows, alphabet, 0.5, 1, W), W - 0.5 * grad / n)
    both = old.withColumnRenamed("text", "old").join(new.withColumnRenamed("text", "new"), "doc_id")
    changed = mz.changed_windows(both, 2)
    G = dense_text([tuple(r) for r in th.change_counts(changed).collect()], alphabet, W)[2]
    after = th.context_rows(mz.kgram_counts(new, 2))
    H = dense_text([tuple(r) for r in mz.kgram_counts(new, 2).collect()], alphabet, W)[3]
    assert np.allclose(th.unlearn_text(changed, after, alphabet, W, tau=0.1).ravel(), W.ravel() - 0.1 * G)
    got = th.unlearn_text(changed, after, alphabet, W, damping=2.0)
    assert np.allclose(got.ravel(), W.ravel() - np.linalg.solve(H + 2.0 * np.eye(W.size), G), atol=1e-8)
    none = mz.changed_windows(old.withColumnRenamed("text", "old").withColumn("new", mz.F.col("old")), 2)
    assert (th.unlearn_text(none, after, alphabet, W, tau=1.0) == W).all()
    kept = th.reduced_windows(fe.char_windows(old, "doc_id", 2), changed.where("old_ctx is not null"), 0.5, 3).collect()
    total = fe.char_windows(old, "doc_id", 2).count()
    n_changed = changed.where("old_ctx is not null").count()
    assert len(kept) == math.floor(0.5 * total) and sum(r.is_changed for r in kept) == math.ceil(0.5 * n_changed)


def test_stored_artefacts(samples, spark, tmp_path):
    df, rows = samples
    vocab = spark.createDataFrame([(j, f"f{j}", "c") for j in range(4)], "dim int, feature string, category string")
    store.save_prepared(Prepared(df, vocab, 4), str(tmp_path), "toy")
    p = store.load_prepared(spark, str(tmp_path), "toy", ["toy"])
    assert p.d == 4 and sorted(map(tuple, p.samples.collect())) == sorted(rows)
    unit = store.load_prepared(spark, str(tmp_path), "toy", ["toy"], normalize=True).samples.collect()
    assert all(not r.val or sum(v * v for v in r.val) == pytest.approx(1) for r in unit)
    with pytest.raises(ValueError):
        store.load_prepared(spark, str(tmp_path), "other", ["toy"])
    keys = [store.save_model(spark, str(tmp_path), dims, np.arange(4.0) + len(dims), {"accuracy": 0.5}) for dims in ([2, 1], [1, 2], [3])]
    assert keys[0] == keys[1] != keys[2]
    theta, report = store.load_models(spark, str(tmp_path))
    assert {(r.model_id, r.dim): r.w for r in theta.collect()} == {(k, j): j + n for k, n in ((keys[1], 2), (keys[2], 1)) for j in range(4)} and report.count() == 2
