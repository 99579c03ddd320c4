"""Every registered opN query on a whole small table: contract columns, types, keys and laws."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from lethe.llm import queries as Q
from lethe.llm.quality import Ftrl, ngrams, vector

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op2_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_benchmark_decontamination": "doc_id bigint, item_id bigint, similarity double",
    "op6_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op7_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op9_hilbert_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op11_embedding_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op13_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
}


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="module")
def result(spark):
    held = {}

    def get(name):
        if name not in held:
            df = Q.QUERIES[name](spark, SF)
            held[name] = (dict(df.dtypes), df.collect())
        return held[name]
    return get


def test_all_are_registered():
    assert {int(k.split("_")[0][2:]) for k in Q.QUERIES} == set(range(1, 14)) and set(COLUMNS) == set(Q.QUERIES)


@pytest.mark.parametrize("name", COLUMNS)
def test_contract_columns(result, texts, name):
    types, rows = result(name)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split()
        assert types[c] == kind, (name, c)
    if name in ("op1_license_scan", "op2_substring_dedup", "op3_toxicity", "op6_exact_dedup", "op7_quality_classifier", "op9_hilbert_sharding", "op10_jaccard_join", "op12_simhash_dedup"):
        assert sorted(r.doc_id for r in rows) == sorted(texts)


@pytest.mark.parametrize("name, cut", [("op3_toxicity", 0.3), ("op7_quality_classifier", 0.7)])
def test_scores_and_folds(result, texts, name, cut):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    truth = dict(zip(labels["doc_id"], labels["toxic" if cut == 0.3 else "quality"]))
    _, rows = result(name)
    right = []
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.held_out and truth.get(r.doc_id) is not None:
            right.append(r.predicted == truth[r.doc_id])
    assert np.mean(right) > 0.8


def test_packing_is_gapless_and_whole(result):
    _, rows = result("op4_best_fit_packing")
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for parts in pieces.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at) and (length == 2048 or k == len(parts) - 1)
            at += length
    total = sum(r.length for r in rows)
    sizes = sorted((r.length for r in rows), reverse=True)
    room = []                                    # best fit, longest first, one piece after the other
    for s in sizes:
        fit = [k for k, v in enumerate(room) if v >= s]
        if fit:
            room[min(fit, key=lambda k: room[k])] -= s
        else:
            room.append(2048 - s)
    assert math.ceil(total / 2048) <= len(places) <= len(room)


def test_conversation_minus_one(result):
    import hashlib
    _, rows = result("op8_chat_formatting")
    t = pq.read_table(f"{SF}/conversations.parquet").to_pydict()
    turns = defaultdict(list)
    for c, k, role, text in zip(t["conv_id"], t["turn"], t["role"], t["text"]):
        turns[c].append((k, role, text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert sorted(r.conv_id for r in rows) == sorted(turns)
    for r in rows:
        said = sorted(turns[r.conv_id])
        assert r.n_turns == len(said) and r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in said).encode()).hexdigest()
        loss = "".join(text for _, role, text in said if role == "assistant")
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_shards_obey_their_law(result, texts):
    _, rows = result("op9_hilbert_sharding")
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)


def test_ftrl_against_a_plain_loop():
    """The same updates, one weight at a time in plain Python, over 200 documents."""
    rng = random.Random(4)
    docs = [(" ".join(rng.choice(["good", "fine", "words", "here"] if k % 2 else ["bad", "JUNK", "!!", "99"]) for _ in range(rng.randrange(0, 30))).encode(), k % 2) for k in range(200)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.1
    z, n, bias = defaultdict(float), defaultdict(float), -1

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)
    model = Ftrl()
    for text, y in docs:
        feats, _ = ngrams([text])
        at, x = vector(feats.ravel())
        model.learn(at, x, float(y))
        sparse = {**dict(zip(at.tolist(), x.tolist())), bias: 1.0}
        w = {i: weight(i) for i in sparse}
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * v for i, v in sparse.items())))))
        for i, v in sparse.items():
            g = (p - y) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    got = model.weights()
    assert len(z) > 20 and all(got[i] == pytest.approx(weight(i), abs=1e-9) for i in z) and np.count_nonzero(got) == sum(weight(i) != 0 for i in z)
