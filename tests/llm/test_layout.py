"""Packing, chat windows, Hilbert shards and the pipeline."""
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lethe.llm import chat
from lethe.llm.chat import escape, format_windows, parse, read_back, unescape
from lethe.llm.hilbert import curve_table, hilbert_shards, manifest
from lethe.llm.packing import best_fit_pack, best_fit_plan, token_bytes
from lethe.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")

# --- packing


def test_token_ids_equal_the_tokenizer():
    whole = Tokenizer.from_file(PATH)
    texts = ["", " \t\n", "It's  we've x'll 'S", "İstanbul ΣΑΣ ß ẞ", "<|endoftext|> a<|startoftext|>b <|x|>", "naïve CAFÉ ½ ² ３ µ × ÷ À ÿ",
             "é \U0001f600​ zx \x00\x01 \x1c\x85", "12 3a4 a..b?!x", "x" * 500, " em ls", "'ll've''d"]
    for t in texts:
        assert np.frombuffer(token_bytes(t.encode(), PATH), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_plan_is_best_fit():
    rng = random.Random(2)
    for capacity in (10, 64, 2048):
        counts = {n: rng.randrange(1, 200) for n in rng.sample(range(1, capacity + 1), min(capacity, 60))}
        used, seen = Counter(), defaultdict(set)
        for length, lo, hi, first, offset in best_fit_plan(counts, capacity):
            for r in range(lo, hi):
                assert used[first + r - lo] == offset and r not in seen[length]
                used[first + r - lo] += length
                seen[length].add(r)
        assert {k: len(v) for k, v in seen.items()} == counts and max(used.values()) <= capacity
        total = sum(n * c for n, c in counts.items())
        assert sorted(used) == list(range(len(used)))
        assert len(used) <= 11 / 9 * -(-total // capacity) + 4 + sum(c for n, c in counts.items() if n > capacity / 2) * 0.25


def test_pack(hard_docs, hard_texts, no_docs):
    out = best_fit_pack(hard_docs, PATH, capacity=64).collect()
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in hard_texts:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, s in enumerate(range(0, len(ids), 64)):
            want[i, k, s, len(ids[s:s + 64]), zlib.crc32(ids[s:s + 64].tobytes())] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    rooms = defaultdict(list)
    for r in out:
        rooms[r.sequence_id].append((r.offset, r.length))
    for spans in rooms.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in out)
    assert len(rooms) <= 1.05 * -(-total // 64) + 2
    assert best_fit_pack(no_docs, PATH).collect() == []

# --- chat


def conversations():
    rng = random.Random(4)
    out = []
    for c in range(30):
        n = rng.randrange(1, 60)
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            out.append((c, t, role, " ".join(rng.choice(["a", "b<|end|>", "\\", "<|", "|>", "é\n"]) for _ in range(rng.randrange(0, 40)))))
    out += [(100, 0, None, None), (100, 1, "assistant", "</s>[INST] ok [/INST]"), (101, 5, "assistant", "x" * 9), (101, 5, "assistant", "x" * 9),
            (101, None, "user", "first"), (None, 0, "user", "u"), (None, 1, "assistant", "<\\|role|\\>"), (102, 0, "assistant", "w " * 900),
            (102, 1, "user", "q"), (102, 2, "assistant", "z"), (103, 0, "we|>ird<|text|>", "t"), (104, 0, "system", "s " * 900), (104, 1, "assistant", "ok")]
    return out


def expected(rows):
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, g in groups.items():
        g.sort()
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in g)
        loss = "".join(x for _, _, r, x in g if r == "assistant")
        out[c] = (len(g), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(2048, 256), (120, 30), (1, 0)])
def test_chat_round_trip(spark, budget, history):
    df = spark.createDataFrame([(*r, "x") for r in conversations()], "conv_id long, turn long, role string, text string, window string").repartition(3)
    windows = format_windows(df, budget, history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(windows).collect()}
    assert got == expected(conversations())
    for w in windows.collect():
        turns = parse(w.text)
        new = turns[w.n_repeated:]
        assert "".join(f"{chat.ROLE}{escape(r)}{chat.TEXT}{escape(t)}{chat.END}" for r, t, _, _ in turns) == w.text and new
        assert [(s.first, s.end) for s in w.loss] == [(a, b) for r, _, a, b in new if r == "assistant"]
        assert w.n_tokens == sum(chat.n_tokens(r, t) for r, t, _, _ in turns)
        system = sum(chat.n_tokens(r, t) for r, t, _, _ in turns[:w.n_repeated] if r == "system")
        assert w.n_tokens <= budget or len(new) == 1 and w.n_tokens - system == chat.n_tokens(new[0][0], new[0][1])
        assert sum(chat.n_tokens(r, t) for r, t, _, _ in turns[:w.n_repeated]) - system <= history


def test_chat_keeps_the_system_turn(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, ("assistant", "user")[t % 2], "w " * 10) for t in range(1, 20)]
    windows = format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 80, 20).orderBy("window").collect()
    assert len(windows) > 3 and all(parse(w.text)[0][:2] == ("system", "be brief") for w in windows)
    assert [w.n_repeated for w in windows[1:]] == [2] * (len(windows) - 1)


@pytest.mark.parametrize("n", [20, 60, 150])
def test_chat_keeps_a_long_system_turn(spark, n):
    rows = [(1, 0, "system", "s " * n), (1, 1, "system", "be brief")] + [(1, t, ("assistant", "user")[t % 2], f"w{t} " * 10) for t in range(2, 20)]
    windows = sorted(chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), 100, 30).collect(), key=lambda w: w.window)
    turns = [[t[:2] for t in parse(w.text)] for w in windows]
    assert len(turns) > 4 and all(t[:2] == [r[2:] for r in rows[:2]] for t in turns[2:])
    new = [t for ts, w in zip(turns, windows) for t in ts[w.n_repeated:]]
    assert new == [r[2:] for r in rows]
    assert all(w.n_tokens <= 100 or len(ts) - w.n_repeated == 1 for ts, w in zip(turns, windows))



def test_escape_is_reversible():
    for parts in itertools.product(["<", "|", ">", "\\", "<|end|>", "x"], repeat=4):
        t = "".join(parts)
        assert unescape(escape(t)) == t and "<|" not in escape(t) and "|>" not in escape(t)


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_windows(none)).collect() == []

# --- shards


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(n, bits):
    table = curve_table(n)

    def place(p):
        s = h = 0
        for i in range(bits - 1, -1, -1):
            s, d = table[(s << n) + sum(((x >> i) & 1) << k for k, x in enumerate(p))]
            h = (h << n) + d
        return h
    order = sorted(itertools.product(range(1 << bits), repeat=n), key=place)
    assert sorted(map(place, order)) == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(order, order[1:]))


def test_shards(hard_docs, hard_texts, no_docs):
    docs = hard_docs.withColumnRenamed("row", "lang").withColumnRenamed("rep", "source")
    out = hilbert_shards(docs, 7).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in hard_texts)
    assert Counter((r.id, r.size, r.text_crc32) for r in out) == want
    slots, cells = defaultdict(list), defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        cells[r.shard].append(r.cell)
    assert sorted(slots) == list(range(7)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(max(cells[k]) <= min(cells[k + 1]) for k in range(6))
    assert hilbert_shards(no_docs).collect() == []
    few = hilbert_shards(docs.filter("doc_id < 4"), 24).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3


def test_manifest_prunes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = hilbert_shards(docs, 24)
    m = manifest(out).collect()
    n = docs.count()
    assert sum(r.rows for r in m) == n and len(m) == 24
    assert np.mean([r.max_d0 - r.min_d0 for r in m]) < 8

# --- pipeline and registration


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


def test_pipeline_equals_its_stages_by_brute_force(spark, sf):
    from test_copies import classes, norm
    from test_text_ops import best_similarity, file_words
    from lethe.llm.toxicity import fit_toxicity, score_toxicity
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    score = {r.id: r.score for r in score_toxicity(docs, *fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    left = [r for r in rows if score[r[0]] < 0.3]
    best = {}
    for r in left:
        k = norm(r[1])
        best[k] = min(best.get(k, (1, 0, r)), (-len(r[1] or ""), r[0], r))
    left = [b[2] for b in best.values()]
    rep = {i: c for i, _, c in classes([(r[0], r[1]) for r in left])}
    left = [r for r in left if rep[r[0]] == r[0]]
    items = [file_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [r for r in left if not any(best_similarity(file_words(r[1]), i) >= 0.8 for i in items)]
    out = corpus_pipeline.run(spark, sf).collect()
    whole = Tokenizer.from_file(PATH)
    want = {r[0]: len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in left}
    got = Counter()
    for r in out:
        got[r.doc_id] += r.length
    assert dict(got) == want


def test_stages_on_an_empty_table(spark, sf, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect() == [], name
        if name != "packing":
            assert docs.columns == no_docs.columns


def test_stages_on_nulls_and_repeated_rows(spark, sf, hard_texts):
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", None) for k, (i, t) in enumerate(hard_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    before = Counter(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).collect()
        if name == "packing":
            assert {r.doc_id for r in out} == {r.doc_id for r in before}
        else:
            after = Counter(out)
            assert not after - before, name            # rows pass unchanged, or go
            before, docs = after, spark.createDataFrame(out, docs.schema)
    assert sum(r.text is None or not r.text.strip() for r in before) == 1     # of the empty texts one stays


def test_near_copies_are_judged_by_row(spark, sf, hard_texts):
    from test_copies import classes
    a = " ".join(f"a{i}" for i in range(60))
    near = " ".join(f"a{i}" for i in range(58)) + " tail end"
    cases = [[(1, a), (None, near), (None, "quite another text than the first of all"), (7, near + " more"), (7, "an unrelated text that has the id of a copy")],
             list(hard_texts) + [(i % 3 or None, t) for i, (_, t) in enumerate(hard_texts)]]
    for rows in cases:
        docs = spark.createDataFrame([(i, t, "row", None, k) for k, (i, t) in enumerate(rows)],
                                     "doc_id long, text string, row string, source string, n_chars long").repartition(3)
        out = corpus_pipeline.jaccard_join(spark, docs, sf)
        assert out.columns == docs.columns
        kept = {r.n_chars for r in out.collect()}
        groups = {}
        for k, _, c in classes([(k, t) for k, (_, t) in enumerate(rows)]):
            groups.setdefault(c, []).append(k)
        assert len(kept) == len(groups)
        for members in groups.values():
            least = min((rows[k][0] is None, rows[k][0] or 0) for k in members)
            (stays,) = kept & set(members)
            assert (rows[stays][0] is None, rows[stays][0] or 0) == least
    assert {r.n_chars for r in corpus_pipeline.jaccard_join(spark, spark.createDataFrame(
        [(i, t, None, None, k) for k, (i, t) in enumerate(cases[0])], docs.schema), sf).collect()} == {0, 2, 4}
