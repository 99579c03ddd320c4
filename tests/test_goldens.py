"""Hand-computed goldens (FIXTURES.md section 3)."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.operators import features as fe
from lethe.operators import linear as lin
from lethe.operators import memorize as mz
from lethe.operators import metrics as me
from lethe.operators import rewrite as rw
from lethe.operators import softmax as sm
from lethe.plans import unlearn as ul

ROWS = [(1, 1.0, [0], [1.0]), (2, -1.0, [1], [2.0]), (3, 1.0, [0, 1], [1.0, 1.0]), (4, -1.0, [], [])]


def _binary(spark):
    return spark.createDataFrame(ROWS, "row_id bigint, y double, idx array<int>, val array<double>")


def test_affected_rows(spark):
    got = sorted(r.row_id for r in rw.affected_rows(_binary(spark), [0]).collect())
    assert got == [1, 3]


def test_loss_gradient(spark):
    s = lin.with_score(_binary(spark), [0.0, 0.0])
    loss = s.agg(lin.loss_l(s, [0.0, 0.0])).collect()[0][0]
    assert abs(loss - 4 * math.log(2)) < 1e-9
    g = lin.to_vector(lin.gradient(_binary(spark), [0.0, 0.0]), 2)
    assert np.allclose(g, [-1.0, 0.5])


def test_change_gradient_and_updates(spark):
    b = _binary(spark)
    G = ul.change_gradient(rw.removal_delta(b, [0]), np.zeros(2), 2)
    assert np.allclose(G, [1.0, 0.0])
    assert np.allclose(ul.first_order(np.zeros(2), G, 0.1), [-0.1, 0.0])
    edited = rw.remove_features(b, [0])
    H = lin.hessian_matrix(edited, [0.0, 0.0], 2, 1.0)
    assert np.allclose(H, np.diag([1.0, 2.25]))
    assert np.allclose(ul.second_order(edited, np.zeros(2), G, 2, 1.0), [-1.0, 0.0])


def test_hvp_matches_hessian(spark):
    b = _binary(spark)
    th = [0.3, -0.2]
    H = lin.hessian_matrix(b, th, 2, 0.5)
    v = np.array([0.7, -1.1])
    assert np.allclose(lin.hvp_vector(b, th, v, 2, 0.5), H @ v)


def test_curves(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.8, -1.0), (0.7, 1.0), (0.1, -1.0)], "p double, y double")
    r = me.roc_pr_auc(df).collect()[0]
    assert abs(r.roc_auc - 0.75) < 1e-9
    assert abs(r.pr_auc - 0.791667) < 1e-6


def test_certification():
    c = ul.certification(0.05, 0.1, 0.01, 1.0)
    assert abs(c["c"] - 3.165639) < 1e-6
    assert abs(c["certified_sigma"] - 1.582820) < 1e-6


def test_vote(spark):
    preds = spark.createDataFrame([(1, -1.0), (1, 1.0), (1, 1.0), (2, -1.0), (2, 1.0)], "row_id int, pred double")
    got = {r.row_id: r.vote for r in me.binary_vote(preds).collect()}
    assert got == {1: 1.0, 2: -1.0}


def test_redaction(spark):
    df = spark.createDataFrame([("alice and bob",)], "text string")
    r = rw.redact_words(df, "text", ["alice", "bob"]).collect()[0]
    assert r.text == "xxxxx and xxx" and r.hits == 2


def test_diagonal_cross(spark):
    def cells(anchor, size, height=8, width=8, channels=3):
        on = sm.diagonal_cross(height, width, channels, anchor, size)
        ids = [r.id for r in spark.range(height * width * channels).where(on(F.col("id"))).collect()]
        assert all(ids.count(i) == 1 for i in ids)
        return sorted({divmod(i // channels, width) for i in ids}), len(ids)
    assert cells((8, 8), 2) == ([(5, 5), (5, 7), (6, 6), (7, 5), (7, 7)], 15)
    assert cells((4, 4), 3) == ([(0, 0), (0, 3), (1, 1), (1, 2), (2, 1), (2, 2), (3, 0), (3, 3)], 24)
    with pytest.raises(ValueError):
        sm.diagonal_cross(8, 8, 1, (2, 8), 2)


def test_pattern_is_added_clipped_and_removed(spark):
    df = spark.createDataFrame([([0.1, 0.8, 0.3],)], "x array<double>")
    on = lambda i: i.isin(0, 1)
    assert df.select(sm.add_pattern("x", on, 0.5)).first()[0] == [0.6, 1.0, 0.3]
    assert df.select(sm.add_pattern("x", on, 0.5, remove=True)).first()[0] == pytest.approx([0.0, 0.3, 0.3])


def test_canary_keeps_every_character(spark):
    text = "a\x01b\nc\n\n\nd"
    df = spark.createDataFrame([(1, text), (2, "no break"), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in fe.insert_canary(df, "doc_id", "<C>", 9, 1, "\n+", 1).collect()}
    assert rows[1].text == "a\x01b\n<C>c\n<C>\n\nd" and rows[1].n_inserted == 2      # as re.finditer: two breaks
    assert rows[2].text == "no break" and rows[3].text == "" and rows[2].n_inserted == 0
    far = fe.insert_canary(df, "doc_id", "<C>", 1, 1, "a", 3).collect()
    assert {r.doc_id: r.text for r in far}[1] == "a\x01b<C>\nc\n\n\nd"


def test_changed_windows_of_unequal_lengths(spark):
    df = spark.createDataFrame([(1, "abcdef", "abXdef"), (2, "abcd", "abcdef"), (3, "same", "same"), (4, None, "abcd"), (5, "ab", "a")],
                               "doc_id long, old string, new string")
    got = sorted((r.doc_id, r.pos, r.old_ctx, r.new_ctx) for r in mz.changed_windows(df, 2).collect())
    assert got == [(1, 0, "ab", "ab"), (1, 1, "bc", "bX"), (1, 2, "cd", "Xd"), (2, 2, None, "cd"), (2, 3, None, "de"), (4, 0, None, "ab"), (4, 1, None, "bc")]


def test_exposure_of_an_unmatched_rank_is_open(spark):
    dist = spark.createDataFrame([(5.0,), (6.0,)], "pp double")
    row = mz.empirical_exposure(dist, 1.0).first()
    assert row["rank"] == 0 and row.exposure is None


def test_softmax_predict(spark):
    W = np.array([[1.0, 0.0], [0.0, 1.0], [500.0, 500.0]])
    row = sm.predict(spark.createDataFrame([([2.0, 1.0],), ([-1.0, 0.5],)], "x array<double>"), W).collect()
    for r, x in zip(row, ([2.0, 1.0], [-1.0, 0.5])):
        z = W @ np.array(x)
        p = np.exp(z - z.max())
        assert np.allclose(r.probs, p / p.sum()) and r.pred == int(np.argmax(z))


def test_windows(spark):
    df = spark.createDataFrame([(1, "abcde")], "doc_id int, text string")
    got = [(r.ctx, r.next) for r in fe.char_windows(df, "doc_id", 2).orderBy("pos").collect()]
    assert got == [("ab", "c"), ("bc", "d"), ("cd", "e")]


def test_recovery():
    assert abs(ul.recovery(0.7382, 0.7686, 0.8786) - 0.216524) < 1e-6


def test_exposure(spark):
    dist = spark.createDataFrame([(float(v),) for v in (6, 8, 10, 12)], "pp double")
    r = mz.empirical_exposure(dist, 6.0).collect()[0]
    assert abs(r.exposure - 2.0) < 1e-12


def test_label_flip_pairs_twice_is_identity(spark):
    df = spark.createDataFrame([(i, i % 10) for i in range(200)], "row_id bigint, label int")
    f = sm.flip_pairs(df, 20, 42)
    assert f.count() == 20
    assert all(r.new_label == 9 - r.old_label for r in f.collect())


def test_removal_gradient_equals_the_change_set(spark):
    rows = [(k, float(1 if k % 3 else -1), sorted({k % 4, (k * 7) % 5}), [0.5 + k, 0.0][: len({k % 4, (k * 7) % 5})]) for k in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, y double, idx array<int>, val array<double>").repartition(3)
    th = [0.3, -0.2, 0.1, 0.4, -0.5]
    one = lin.to_vector(lin.removal_gradient(df, th, [1, 3]), 5, value="g")
    two = lin.to_vector(lin.gradient_diff(rw.removal_delta(df, [1, 3]), th), 5, value="g")
    assert np.allclose(one, two, atol=1e-9) and np.any(one)
