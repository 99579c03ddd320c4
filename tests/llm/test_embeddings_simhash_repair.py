"""Whitening, SimHash near-dedup and conversation repair against brute force and SQL."""
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import Row

from lethe.llm import queries as Q
from lethe.llm import repair as R
from lethe.llm import simhash as S
from lethe.llm import whitening as W

SF = "/root/testdata/sf0.001"


# Whitening ----------------------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame([Row(vec_id=i, embedding=v, id="x", component="y", n="z", vec="w") for i, v in rows],
                                 "vec_id long, embedding array<float>, id string, component string, n string, vec string").repartition(4)


def plain_whitening(vecs, k, offset):
    x = [[int(np.floor(64 * float(np.float32(c)))) + offset for c in v] for v in vecs]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    z = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    values, q = np.linalg.eigh(z.T @ z / n)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return n, dev, z @ q / np.sqrt(values), values / np.trace(z.T @ z / n)


def check_whitening(out, vecs, ids, k, offset):
    n, dev, want, explained = plain_whitening(vecs, k, offset)
    rows = out.collect()
    assert len(rows) == len(vecs) * k and {r.n for r in rows} == {n}
    assert max(r.identity_error for r in rows) <= 1e-9 and len({r.identity_error for r in rows}) == 1
    got = {}
    for r in rows:
        got.setdefault(r.id, {}).setdefault(r.component, []).append(r)
    sign = {}
    for at, i in enumerate(ids):
        for c in range(1, k + 1):
            r = got[i][c][0]
            s = sign.setdefault(c, np.sign(r.whitened * want[at, c - 1]) if abs(want[at, c - 1]) > 1e-3 else 0) or 1
            assert abs(r.whitened * s - want[at, c - 1]) < 1e-8 * max(1, abs(want[at, c - 1])) or not sign[c]
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)
            assert r.deviation == dev[at]


def test_whitening_matches_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.standard_normal(6) * [3, 2, 1, .7, .5, .3]).astype(np.float32).tolist()) for i in range(150)]
    good.append((None, [0.5] * 6))
    bad = [(1000, None), (1001, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, []), (1005, [0.1, 0.2])]
    out = W.whitened_vectors(vectors(spark, good + bad), k=4, offset=1_000_000)
    check_whitening(out, [v for _, v in good], [i for i, _ in good], 4, 1_000_000)


def test_whitening_of_whole_table(spark):
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    out = Q.QUERIES["op11_embedding_whitening"](spark, SF)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(out.withColumnRenamed("vec_id", "id"), t["embedding"], t["vec_id"], 32, 1_000_000)


def test_whitening_without_spread(spark):
    assert W.whitened_vectors(vectors(spark, [])).count() == 0
    assert W.whitened_vectors(vectors(spark, [(1, [0.5, 0.25])])).count() == 0
    assert W.whitened_vectors(vectors(spark, [(i, [0.5, 0.25]) for i in range(5)])).count() == 0
    rank1 = W.whitened_vectors(vectors(spark, [(i, [float(i), float(2 * i), 7.0]) for i in range(5)])).collect()
    assert len(rank1) == 5 and {r.component for r in rank1} == {1}
    huge = W.whitened_vectors(vectors(spark, [(i, [3e30 * (i % 2), float(i)]) for i in range(6)])).collect()
    assert len(huge) == 6 * len({r.component for r in huge}) and {r.deviation for r in huge} == {None}


@pytest.mark.parametrize("kind", ["spread", "equal", "blocks", "low rank", "graded"])
def test_slices_count_and_converge(kind):
    rng = np.random.default_rng(5)
    d = 24
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {"spread": np.linspace(1, 9, d), "equal": np.full(d, 3.0), "blocks": np.repeat([5.0, 5 - 1e-9, 1.0], 8),
              "low rank": np.r_[np.linspace(1, 2, 7), np.zeros(d - 7)], "graded": 4.0 ** -np.arange(d)}[kind]
    a = turn * values @ turn.T
    a = (a + a.T) / 2
    got, q = W.leading(a, 16)
    want = np.sort(values)[::-1][:16]
    assert len(got) == (want > W.RANK_TOL * values.sum()).sum()
    assert np.allclose(got, want[:len(got)], atol=1e-13 * want[0], rtol=0)
    assert np.abs(q.T @ q - np.eye(len(got))).max() < 1e-13
    assert np.abs(a @ q - q * got).max() < 1e-13 * want[0]
    for shift in (*(want[:-1] + want[1:]) / 2, -1.0, 100.0):
        if np.abs(values - shift).min() > 1e-6:
            assert W.above(a, shift) == (values > shift).sum()
    b = rng.standard_normal(d)
    assert np.allclose(a @ W.Factor(a - 0.37 * np.eye(d), 0.0).solve(b) - 0.37 * W.Factor(a, 0.37).solve(b), b)


# SimHash --------------------------------------------------------------------------------------
def plain_fingerprint(text):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))


def plain_groups(fps, budget=2):
    u = np.array(sorted(set(fps)), dtype=np.uint64)
    name = {int(v): int(v) for v in u}

    def find(v):
        while name[v] != v:
            v = name[v]
        return v
    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None]) <= budget, 1))):
        a, b = find(int(u[i])), find(int(u[j]))
        name[max(a, b)] = min(a, b)
    return {v: find(v) for v in name}


def check_simhash(out, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = plain_groups(fps)
    low = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            low[group[f]] = min(i, low.get(group[f], i))
    want = sorted(((i, f"{f:016x}", low.get(group[f])) for (i, _), f in zip(rows, fps)), key=repr)
    assert sorted(((r.id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in out.collect()), key=repr) == want


def test_fingerprints_in_slices(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"W{rng.randrange(50)}" for _ in range(n)) for n in (0, 1, 2, 3, 4, 300)] + ["x" * 500, "é ü ß\tA\rb\nC", " \n "]
    whole = [S.fingerprint(t.encode()) for t in texts]
    assert whole == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(S, "_SLICE", 7)
    assert [S.fingerprint(t.encode()) for t in texts] == whole


def test_simhash_on_hard_documents(spark, hard_docs, hard_texts):
    for leaf in (S.LEAF, 3):
        check_simhash(S.simhash_components(hard_docs, leaf=leaf), hard_texts)


def test_simhash_of_whole_table(spark, no_docs):
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    out = Q.QUERIES["op12_simhash_dedup"](spark, SF)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    check_simhash(out.selectExpr("doc_id AS id", "cast(conv(fingerprint, 16, -10) AS long) AS fp", "component_id"), list(zip(t["doc_id"], t["text"])))
    assert S.simhash_components(no_docs).count() == 0


def test_trie_join_finds_each_link_once():
    rng = np.random.default_rng(1)
    for dense in (6, 64):
        u = [rng.integers(0, 2**64, 300, dtype=np.uint64)]
        centre = rng.integers(0, 2**64, 20, dtype=np.uint64)
        for _ in range(500):
            v = centre[rng.integers(20)]
            for _ in range(rng.integers(0, 7)):
                v ^= np.uint64(1) << np.uint64(rng.integers(dense))
            u.append(np.array([v]))
        u = np.unique(np.concatenate([*u, np.array([0, 1, 2**63, 2**64 - 1], dtype=np.uint64)]))
        for budget in (0, 1, 2, 3):
            want = set(zip(*(v.tolist() for v in np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None]) <= budget, 1)))))
            got = [p for i, j in S.trie_links(u, None, budget) for p in zip(i.tolist(), j.tolist())]
            assert len(got) == len(set(got)) and set(got) == want
            cut = np.array_split(u, 11)
            first = np.cumsum([0] + [len(c) for c in cut])
            got = [(i + first[r], j + first[q]) for r, q in S.range_pairs(np.array([c[0] for c in cut]), np.array([c[-1] for c in cut]), budget).tolist()
                   for a, b in S.trie_links(cut[r], None if r == q else cut[q], budget) for i, j in zip(a.tolist(), b.tolist())]
            assert len(got) == len(set(got)) and set(got) == want


def test_blocks_of_open_pairs(monkeypatch):
    u = np.unique(np.random.default_rng(4).integers(0, 1 << 12, 2000, dtype=np.uint64))
    want = sum(len(i) for i, _ in S.trie_links(u, None, 2))
    monkeypatch.setattr(S, "_BLOCK", 50)
    assert sum(len(i) for i, _ in S.trie_links(u, None, 2)) == want


# Conversation repair ------------------------------------------------------------------------------
def plain_repair(rows):
    """(cost, audit) of the best repair by trying every edit of up to a few rows."""
    legal, best = re.compile(r"(s?(ua)+)?\Z"), []

    def go(i, cost, audit, roles, inserted):
        if best and cost > best[0][0]:
            return
        if i == len(rows) and legal.match(roles):
            best[:] = [min(best + [(cost, audit)])]
        if inserted < 3:
            for t in "ua":
                go(i, cost + 2, audit + "I", roles + t, inserted + 1)
        if i < len(rows):
            initial, gone, truncated = rows[i]
            go(i + 1, cost + 3, audit + "D", roles, inserted)
            if not gone:
                go(i + 1, cost + truncated, audit + "K", roles + (initial or "?"), inserted)
                for t in "ua":
                    go(i + 1, cost + 2 + truncated, audit + "R", roles + t, inserted)
    go(0, 0, "", "", 0)
    return best[0]


def gss(rows, parser):
    edits = [e for k, r in enumerate(rows) for e in parser.put(k, *r)]
    cost, rest = parser.end()
    return cost, edits + rest


def test_repair_is_cheapest_and_least():
    rng, parser = random.Random(0), R.Repair(R.Automaton())
    for _ in range(250):
        rows = [(rng.choice(["s", "u", "a", "t", ""]), rng.random() < .15, False) for _ in range(rng.randrange(5))]
        rows = [(i, g, not g and rng.random() < .2) for i, g, _ in rows]
        cost, edits = gss(rows, parser)
        assert (cost, "".join(e[1] for e in edits)) == plain_repair(rows)
        roles = "".join({"user": "u", "assistant": "a"}.get(e[2]) or rows[e[0]][0] for e in edits if e[1] != "D")
        assert re.fullmatch(r"(s?(ua)+)?", roles)


def test_settled_edits_and_pruning_change_nothing(monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suuaaat"), rng.random() < .1, False) for _ in range(rng.randrange(200))]
        monkeypatch.setattr(R, "_SETTLE", 1 << 14)
        want = gss(rows, R.Repair(R.Automaton(), slack=10**9))
        monkeypatch.setattr(R, "_SETTLE", 7)
        assert gss(rows, R.Repair(R.Automaton())) == want
    parser = R.Repair(R.Automaton())
    for k in range(5000):
        parser.put(k, "ua"[k % 2], False, False)
    assert len(parser.rows) < 100


def test_grammar_is_a_parameter():
    pairs = R.Automaton((("C", ""), ("C", "T"), ("T", "ua"), ("T", "Tua")))
    assert gss([(c, False, False) for c in "sua"], R.Repair(pairs))[0] == R.DELETE
    with pytest.raises(ValueError):
        R.Automaton((("C", ""), ("C", "uCa")))


HARD_TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."),
    (2, None, None, None), (2, None, "user", " \t\n"), (2, 5, "tool", "call"), (2, 9, "", "x."), (2, 9, "user", "first?"), (2, 9, "assistant", "same turn."),
    (None, 0, "user", "no conversation."), (None, None, "assistant", "no turn."), (None, 1, "assistant", "é. "),
    (3, 0, "assistant", "starts wrong."), (3, 1, "assistant", "again"), (3, 2, "user", "a: b\nuser:c."), (3, 7, "system", "late."),
    (4, 0, "user", "x" * 200_000), (5, 0, "User", "case."), (5, 1, "assistant", "ok."),
] + [(6, i, "ua"[i % 2] + "ser", f"turn {i}" + ".!?"[i % 3]) for i in range(300)] + [(c, 0, "user", "one.") for c in range(100, 200)]


def test_repair_matches_sql_on_hard_turns(spark, tmp_path):
    rows = [Row(conv_id=c, turn=t, role=r, text=x, conv="q", row="z", place="y", edit="k", report="r") for c, t, r, x in HARD_TURNS]
    schema = "conv_id long, turn long, role string, text string, conv string, row string, place string, edit string, report string"
    for turns in (rows, []):
        df = spark.createDataFrame(turns, schema).repartition(3)
        got = R.repaired_digests(*R.repair_conversations(R.damaged(R.turn_rows(df))))
        con = duckdb.connect()
        con.register("conversations", pa.table({c: pa.array([r[c] for r in turns], t) for c, t in
                                                (("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()))}))
        rel = con.sql(Q.ORACLE["op13_conversation_repair"])
        assert rel.columns == got.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_repaired_turns(spark):
    reports, repaired = R.repair_conversations(R.turn_rows(spark.createDataFrame(
        [(7, 0, "assistant", "Lead."), (7, 1, "user", "Hm?"), (7, 2, "user", "Hm?"), (7, 3, "assistant", "Cut"), (8, 0, "user", " ")],
        "conv_id long, turn long, role string, text string")))
    assert {r.conv_id: (r.cost, r.audit) for r in reports.collect()} == {7: (2 + 3 + 1, "IKKDK"), 8: (3, "D")}
    turns = [(r.role, r.text, r.edit) for r in repaired.orderBy("conv_id", "place").collect()]
    assert turns == [("user", "", "I"), ("assistant", "Lead.", "K"), ("user", "Hm?", "K"), ("assistant", "Cut", "K")]


def test_damage_by_key(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(12) for t in range(12)] + [(None, None, "assistant", "A.")]
    out = R.damaged(R.turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text), kind == 0)
        want += [row] * (2 if kind == 3 else 1)
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
