"""Steps rebuilt to scale, against plain Python on rows of the tests' own."""
import math
from collections import Counter

import numpy as np

from lethe.operators import blocks as bl
from lethe.operators import features as fe
from lethe.operators import linear as lin
from lethe.operators import memorize as mz
from lethe.operators import rewrite as rw
from lethe.operators import sampling as sa
from lethe.plans import grid as gr
from lethe.plans import solvers
from lethe.plans import text_head as th
from lethe.plans import unlearn as ul
from lethe.queries import QUERIES
from lethe.sources import standins

TEXTS = [(1, "abcab\ncab"), (2, ""), (3, None), (4, "é𝄞é𝄞é𝄞"), (None, "abcabc"), (1, "abcab\ncab")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_breaks_are_chosen_outside_the_lambda_of_the_pieces(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")], "doc_id bigint, text string")
    one = fe.insert_canary(df, "doc_id", "<C>", 1, 1, "\n", 1).select("doc_id", "text")
    assert "array_contains(CASE" not in plan(one)
    assert one.first().text.replace("<C>", "") == "a\nb\nc" and one.first().text.count("<C>") == 1


def test_windows_are_counted_by_number_and_by_string(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    for k, step in ((2, 1 << 21), (2, 4), (20, 1 << 21)):
        monkeypatch.setattr(mz, "STEP_CHARS", step)
        long = df.union(spark.createDataFrame([(9, "".join(map(chr, range(97, 123))) * 2)], df.schema))
        want = Counter((t[i:i + k], t[i + k]) for t in [r.text for r in long.collect()] if t for i in range(len(t) - k))
        counts = mz.kgram_counts(long, k)
        assert {(r.ctx, r.next): r.n for r in counts.collect()} == want
        assert "explode" not in plan(counts)


def test_changed_windows_of_texts_of_different_length(spark):
    df = spark.createDataFrame([(1, "abcdef", "abXdef"), (2, "abc", "abcd"), (None, "abcd", None), (4, "same", "same")], "doc_id bigint, old string, new string")
    side = lambda t, p: (t[p:p + 2], t[p + 2]) if p + 2 < len(t) else (None, None)
    want = [(r.doc_id, p, *side(r.old, p), *side(r.new or "", p)) for r in df.collect()
            for p in range(max(len(r.old), len(r.new or "")) - 2) if side(r.old, p) != side(r.new or "", p)]
    out = mz.changed_windows(df, 2)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert "Generate" not in plan(out)


def test_hash_is_computed_once_a_row_of_a_cut(spark):
    df = spark.range(3000).selectExpr("id", "id % 2 = 0 as g")
    cut = sa.hash_cut(df, "id", 7, lambda have: {g: n // 3 for g, n in have.items()}, by="g")
    assert sorted(r["count"] for r in cut.groupBy("g").count().collect()) == [500, 500]
    assert plan(cut.select("id")).count("md5(") <= 2


def test_reduced_windows_meet_the_change_set_by_text(spark):
    windows = spark.createDataFrame([(d, p, "a", "b") for d in (1, 2, None) for p in range(6)], "doc_id bigint, pos int, ctx string, next string")
    changed = spark.createDataFrame([(1, 2), (1, 2), (1, 5), (None, 3)], "doc_id bigint, pos int")
    rows = th.reduced_windows(windows, changed, 1.0, 3).collect()
    assert Counter((r.doc_id, r.pos) for r in rows if r.is_changed) == {(1, 2): 2, (1, 5): 1}
    assert len(rows) == 19


def test_coded_and_decoded_text_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    vocab = fe.char_vocab(df.where("doc_id = 1"))
    out = fe.decode_text(fe.encode_text(df, vocab), vocab, name="back")
    assert out.columns == ["doc_id", "text", "codes", "back"]
    known = set("abc\n")
    for r in out.collect():
        assert r.back == (None if r.text is None else "".join(c if c in known else "�" for c in r.text))
        assert r.text is None or [c is None for c in r.codes] == [c not in known for c in r.text]
    assert "transform" not in plan(out)


def test_gradient_difference_skips_rows_with_nulls(spark):
    rows = [(1.0, [0, 1], [0.5, 2.0], 1.0, [0], [0.5]), (-1.0, [1], [1.0], 1.0, [1], [1.0]), (None, [0, 2], [1.0, 1.0], None, [2], [1.0])]
    delta = spark.createDataFrame(rows, "y double, idx array<int>, val array<double>, y_delta double, idx_delta array<int>, val_delta array<double>")
    theta, want = [0.3, -0.2, 0.1], np.zeros(3)
    for y, i, v, y2, i2, v2 in rows[:2]:
        for sign, a, at, b in ((1, y2, i2, v2), (-1, y, i, v)):
            want[at] += sign * -a / (1 + np.exp(a * np.dot(np.array(theta)[at], b))) * np.array(b)
    got = {r.dim: r.g for r in lin.gradient_diff(delta, theta).collect()}
    assert got[2] is None and np.allclose([got[0], got[1]], want[:2])


def sparse(spark, n=300, d=4):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        idx = sorted(rng.choice(d, rng.integers(0, d + 1), replace=False).tolist())
        rows.append((i, float(rng.choice([-1, 1])), idx, rng.uniform(-1, 1, len(idx)).tolist()))
    return spark.createDataFrame(rows, "row_id bigint, y double, idx array<int>, val array<double>")


def test_packed_rows_give_what_plain_rows_give(spark, monkeypatch):
    monkeypatch.setattr(bl, "PACK_ROWS", 50)
    plain, theta, d = sparse(spark), [0.5, -1.0, 0.25, 2.0], 4
    packed = bl.packed(plain, "y", "idx", "val")
    assert packed.columns == ["pack"] and packed.count() >= 1 and bl.packed(packed, "y") is packed
    read = lambda rows: bl.block_sums(rows, lambda batches: {0: np.array([sum(b.num_rows for b in batches)])})[0][0]
    assert read(packed) == 300
    for dims in ([0], [1, 3]):
        for a, b in ((plain, packed), (rw.remove_features(plain, dims), rw.remove_features(packed, dims))):
            assert np.allclose(lin.hessian_matrix(a, theta, d), lin.hessian_matrix(b, theta, d))
            assert np.allclose(lin.hvp_vector(a, theta, theta, d, 0.5), lin.hvp_vector(b, theta, theta, d, 0.5))
            assert np.allclose(solvers.loss_gradient(a, np.array(theta))[1], solvers.loss_gradient(b, np.array(theta))[1])
            assert np.allclose(solvers.fit_lbfgs(a, d, 1.0), solvers.fit_newton(b, d, 1.0)[None], atol=1e-6)
        G = [ul.change_gradient(rw.removal_delta(rows.select("row_id", "y", "idx", "val") if rows is plain else rows, dims), theta, d) for rows in (plain, packed)]
        assert np.allclose(*G) and np.allclose(G[0], lin.to_vector(lin.removal_gradient(plain, theta, dims), d, value="g"))


def test_small_and_wide_rows_meet_the_models_alike(spark, monkeypatch):
    rows, rng = bl.packed(sparse(spark), "y", "idx", "val"), np.random.default_rng(2)
    keep = rng.random((6, 4)) < 0.6
    g = gr.Grid(rng.normal(size=(6, 4)), keep, np.full(6, -1), np.array([False, True] * 3))
    x = next(x for _, x in bl.row_chunks(sparse(spark).toArrow().to_batches(), 1))
    assert isinstance(x.small(4), bl.Dense) and x.small(bl.DENSE + 1) is x
    for a, b in ((x, x.small(4)), (x.where(x.row[:1] == np.arange(x.n)), x.small(4).where(x.row[:1] == np.arange(x.n)))):
        assert np.allclose(a.dot(g.theta.T), b.dot(g.theta.T)) and (a.has(1.0 * keep.T) == b.has(1.0 * keep.T)).all()
        assert np.allclose(a.tdot(np.ones((a.n, 2)), 4), b.tdot(np.ones((a.n, 2)), 4))
    dense = gr.grid_stats(rows, g, hessian=True, vectors=g.theta)
    monkeypatch.setattr(gr, "PAIRS", 0)
    wide = gr.grid_stats(rows, g, hessian=True, vectors=g.theta)
    assert all(np.allclose(a, b) for a, b in zip(vars(dense).values(), vars(wide).values()))


def test_a_loop_does_not_keep_a_kept_table_twice(spark):
    with solvers.persisted(bl.packed(sparse(spark), "y", "idx", "val")) as rows:
        with solvers.persisted(rows) as again:
            assert again is rows
        assert rows.storageLevel.useMemory


def test_numeric_rows_of_one_split_are_built_from_it_alone(spark, sf):
    whole = standins.numeric_samples(spark, sf, keyed=True).samples
    for split in ("train", "test"):
        key = lambda r: (r.row_id, r.y, tuple(r.idx), tuple(r.val))
        want, part = whole.where(f"split = '{split}'"), standins.numeric_samples(spark, sf, keyed=True, split=split).samples
        assert Counter(map(key, want.collect())) == Counter(map(key, part.collect()))
    some = spark.range(2000).select(standins.split_col("id").alias("a"), standins.split_col("id", 3, 0.37).alias("b"), (standins.uniform("id", 42) < 0.8).alias("c"),
                                    (standins.uniform("id", 3) < 0.37).alias("d")).collect()
    assert all((r.a == "train") == r.c and (r.b == "train") == r.d for r in some)


def test_numeric_rows_are_built_once_for_all_steps(spark, sf, monkeypatch):
    from lethe.queries import q_plans
    made = []
    build = standins.numeric_samples
    monkeypatch.setattr(q_plans, "numeric_samples", lambda *a, **k: made.append(build(*a, **k)) or made[-1])
    with q_plans._numeric(spark, sf) as (train, edited, delta, _):
        assert bl.is_packed(train) and train.storageLevel.useMemory and all("InMemoryTableScan" in x._jdf.queryExecution().executedPlan().toString() for x in (edited, delta))
    assert len(made) == 1 and not train.storageLevel.useMemory


def test_windows_of_a_small_alphabet_are_counted_in_a_table(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    want = {(r.ctx, r.next): r.n for r in mz.kgram_counts(df, 2).collect()}
    monkeypatch.setattr(mz, "TABLE_BITS", 0)
    assert {(r.ctx, r.next): r.n for r in mz.kgram_counts(df, 2).collect()} == want


def test_text_head_writes_its_texts_once(spark, sf, monkeypatch):
    from lethe.queries import q_canary
    kept = []
    keep = th.persisted
    monkeypatch.setattr(th, "persisted", lambda df: kept.append(df.columns) or keep(df))
    assert len(QUERIES["u13_text_head_unlearning"](spark, sf).collect()) == 4
    assert kept[0] == ["doc_id", "old", "new"]


def dense(rows, d=4):
    """The sparse rows as dense packs."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("y"), b.column("shard"), bl.fixed_lists(bl.Rows(b).dense(d))], names=["y", "shard", "x"])
    return rows.select("y", "shard", "idx", "val").mapInArrow(lambda batches: bl.to_packs(run(batches)), "pack binary")


def test_dense_packs_give_what_sparse_rows_give(spark, monkeypatch):
    monkeypatch.setattr(bl, "CELLS", 64)
    plain, theta, d, rng = sa.assign_shards(sparse(spark, 3000), "row_id", 3), [0.5, -1.0, 0.25, 2.0], 4, np.random.default_rng(3)
    packs, keep = dense(plain), rng.random((5, 4)) < 0.6
    assert bl.is_packed(packs)
    grids = [gr.Grid(rng.normal(size=(5, 4)), keep, np.full(5, -1), np.array([False, True, False, True, True])), gr.grid(rng.normal(size=(6, 4)), shard=[0, 1, 2] * 2, untouched=True)]
    for dims in ([], [0], [1, 3]):
        a, b = rw.remove_features(plain, dims), rw.remove_features(packs, dims)
        for g in grids:
            one, two = (gr.grid_stats(x, g, hessian=True, vectors=g.theta) for x in (a, b))
            assert all(np.allclose(u, v) for u, v in zip(vars(one).values(), vars(two).values()))
        assert np.allclose(lin.hessian_matrix(a, theta, d), lin.hessian_matrix(b, theta, d))
        assert np.allclose(solvers.fit_lbfgs(a, d, 1.0), solvers.fit_lbfgs(b, d, 1.0), atol=1e-6)
        assert np.allclose(lin.hvp_vector(a, theta, theta, d), lin.hvp_vector(b, theta, theta, d))
        deltas = [{r.dim: r.g for r in lin.gradient_diff(rw.removal_delta(x, dims), theta).collect()} for x in (plain, packs)]
        assert deltas[0].keys() == deltas[1].keys() and all(np.isclose(g, deltas[1][j]) for j, g in deltas[0].items())
    before = np.ones_like(keep)
    assert np.allclose(gr.change_gradients(plain, grids[0].theta, before, keep), gr.change_gradients(packs, grids[0].theta, before, keep))
    assert (gr.touched_rows(plain, keep) == gr.touched_rows(packs, keep)).all()
    votes = [gr.vote_right(x, grids[1].theta.reshape(2, 3, 4), keep[:2]) for x in (plain, packs)]
    assert votes[0][0] == votes[1][0] == 3000 and (votes[0][1] == votes[1][1]).all()
    sample = (1.0, np.array([0.1, 0.2, 0.3, 0.4]))
    assert np.allclose(*(gr.block_influence(x, theta, sample, [[0], [1, 3]], 1.0) for x in (plain, packs)))


def test_numeric_packs_are_dense_and_hold_all_rows(spark, sf):
    want = Counter((r.y, *(dict(zip(r.idx, r.val)).get(j, 0.0) for j in range(4))) for r in standins.numeric_samples(spark, sf, split="train").samples.collect())
    packs, got = standins.numeric_samples(spark, sf, split="train", packs=True, deals={"shard": (5, 3)}).samples, Counter()
    for b in bl.unpacked(packs.toArrow().to_batches()):
        assert b.schema.names == ["shard", "y", "x"]
        got.update(zip(b.column("y").to_pylist(), *bl.matrix(b.column("x")).T.tolist()))
    assert got == want


def test_logarithms_of_many_rows_are_added_up_exactly():
    rng = np.random.default_rng(4)
    for e in (np.ones((5001, 2)), rng.random((1, 3)), rng.random((777, 1)) * 1e-18, 10.0 ** rng.uniform(-30, 0, (4096, 3)), np.zeros((0, 2))):
        want = [math.fsum(np.log1p(c)) for c in e.T]
        assert np.allclose(gr._log1p_sums(e), want, rtol=1e-13, atol=0)
