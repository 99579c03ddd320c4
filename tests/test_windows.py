"""Windows cut while they are held as texts, against the cut of their rows and plain Python."""
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from lethe.functions.rand import position_draws
from lethe.operators import features as fe
from lethe.operators import memorize as mz
from lethe.operators import windows as wi
from lethe.plans import text_head as th
from lethe.queries import QUERIES
from lethe.queries import q_canary as qc


def draw(text, seed):
    return int(hashlib.md5(f"{text}:{seed}".encode()).hexdigest()[:8], 16)


def test_draws_of_positions_are_those_of_the_strings():
    runs = [("1:", 0, 1200), ("", 5, 20), ("é:", 9_999_990, 20), ("x" * 60 + ":", 95, 10), ("-17:", 9_999_999_998, 4), ("123456:", 0, 20_000)]
    got = position_draws([p.encode() for p, _, _ in runs], [f for _, f, _ in runs], [n for _, _, n in runs], 59)
    assert got.dtype == np.uint32 and got.tolist() == [draw(f"{p}{i}", 59) for p, f, n in runs for i in range(f, f + n)]
    assert len(position_draws([], [], [], 59)) == 0


@pytest.fixture(scope="module")
def pairs(spark):
    """(doc_id, old, new) with null and repeated keys, null and short texts, and texts that differ in length."""
    rnd, rows = random.Random(3), []
    for i in range(60):
        text = None if i % 19 == 0 else "".join(rnd.choice("abc é漢😀\n") for _ in range(rnd.choice([0, 3, 4, 5, 20, 200, 900])))
        at = rnd.randrange(len(text)) if text and i % 3 else None
        rows.append((rnd.choice([None, 1, 2, i, i, i * 1000]), text, text if at is None else text[:at] + rnd.choice(["X", "XY", ""]) + text[at + 1:]))
    return spark.createDataFrame(rows, "doc_id bigint, old string, new string").repartition(3).localCheckpoint()


def expected(rows, change, r, seed):
    """(doc_id, pos, ctx, next, is_changed) of reduced windows; a window meets every row of the change set with its key and position."""
    every = {True: [], False: []}
    for key, text in rows:
        for p in range(max(len(text or "") - 4, 0)):
            times = change[key, p] if key is not None else 0
            name = str(p) if key is None else f"{key}:{p}"
            every[times > 0] += [(draw(name, seed), name, (key, p, text[p:p + 4], text[p + 4], times > 0))] * max(times, 1)
    keep = math.ceil(r * len(every[True]))
    quota = {True: keep, False: max(math.floor(r * sum(map(len, every.values()))) - keep, 0)}
    out = Counter()
    for g, found in every.items():
        found.sort(key=lambda x: x[:2])
        if quota[g]:        # rows that share draw and name with the last one stay together
            last = found[min(quota[g], len(found)) - 1][:2]
            out.update(x[2] for x in found if x[:2] <= last)
    return out


@pytest.mark.parametrize("step, share", [(None, None), (300, None), (300, 0.01), (None, 0.97)])
def test_packed_windows_are_reduced_as_rows_are(spark, pairs, monkeypatch, step, share):
    # small packs cut texts in pieces; a share that is wrong puts the boundary outside what the packs foresaw
    real = wi.cut_windows
    monkeypatch.setattr(th, "cut_windows", lambda rows, k, seed, r, *a: real(rows, k, seed, share or r, *a, step or wi.STEP))
    old = pairs.selectExpr("doc_id", "old as text")
    changed = mz.changed_windows(pairs, 4).where("old_ctx is not null")
    change = Counter((r.doc_id, r.pos) for r in changed.collect())
    for r in (0.0, 0.25, 1.0):
        got = th.reduced_windows(fe.char_windows(old, "doc_id", 4, packed=True), changed, r, 59, length=4)
        assert got.columns == ["doc_id", "pos", "ctx", "next", "is_changed"]
        assert Counter(map(tuple, got.collect())) == expected([tuple(x) for x in old.collect()], change, r, 59)
    if step is None and share is None:
        rows = th.reduced_windows(fe.char_windows(old, "doc_id", 4), changed, 0.25, 59)
        packed = th.reduced_windows(fe.char_windows(old, "doc_id", 4, packed=True), changed, 0.25, 59, length=4)
        assert Counter(map(tuple, packed.collect())) == Counter(map(tuple, rows.collect()))
        assert packed.dtypes == rows.dtypes


def test_no_packs_no_windows(spark):
    none = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id bigint, text string")
    changed = spark.createDataFrame([], "doc_id bigint, pos int")
    assert th.reduced_windows(fe.char_windows(none, "doc_id", 4, packed=True), changed, 0.5, 1, length=4).collect() == []


def test_reduced_windows_query_builds_only_those_it_keeps(spark, tmp_path):
    texts = [(i, f"Line {i}\nand another one, Ünï {i * i}\nlast") for i in range(40)] + [(99, "no break at all"), (100, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["j5_reduced_windows"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and "Generate" not in plan
    both = [tuple(r) for r in qc._both(spark, str(tmp_path)).select("doc_id", "old", "new").collect()]
    change = Counter((k, p) for k, o, n in both for p in range(max(len(o or "") - 4, 0)) if o[p:p + 5] != n[p:p + 5])
    assert change and Counter(map(tuple, out.collect())) == expected([(k, o) for k, o, _ in both], change, qc.REDUCTION, qc.REDUCE_SEED)
