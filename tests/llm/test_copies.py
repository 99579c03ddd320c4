"""Substring dedup, exact dedup and the Jaccard join against brute force."""
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lethe.llm import exact, jaccard
from lethe.llm.exact import RadixTree, drop_copies, exact_dedup, radix_groups
from lethe.llm.jaccard import choose_prefix, jaccard_components, needed, shingle_sets
from lethe.llm.substrings import substring_dedup
from lethe.llm.words import split

BIG = float("inf")
SPACE = re.compile("[\x20\x09-\x0d]+")


def tokens(text):
    return [w for w in SPACE.split(text or "") if w]


def key(i):
    return BIG if i is None else i


def cut(texts, window):
    first = {}
    for i, t in texts:
        w = tokens(t)
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, BIG), key(i))
    out = Counter()
    for i, t in texts:
        w = tokens(t)
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < key(i):
                keep[s:s + window] = [False] * window
        out[i, len(w), tuple(k for k, b in enumerate(keep) if not b), " ".join(x for x, b in zip(w, keep) if b)] += 1
    return out


@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup(hard_docs, hard_texts, window):
    got = Counter()
    for r in substring_dedup(hard_docs, window=window).collect():
        got[r.id, r.n_words, tuple(k for s in r.spans for k in range(s.first, s.last + 1)), r.kept_text] += 1
    assert got == cut(hard_texts, window)


def norm(text):
    return SPACE.sub("", text or "")


def test_exact_dedup(hard_docs, hard_texts):
    groups = defaultdict(list)
    for i, t in hard_texts:
        groups[norm(t)].append((-len(t or ""), key(i), i))
    want = Counter()
    for i, t in hard_texts:
        g = groups[norm(t)]
        want[i, min(g)[2], len(g), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    for limits in ({}, {"chunk_bytes": 2000, "leaf_bytes": 300}):
        rows = exact_dedup(hard_docs, **limits).collect()
        assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
        assert sum(r.kept for r in rows) == len(groups)
        assert all(r.id == r.keep_id for r in rows if r.kept)


def test_drop_copies_keeps_columns(hard_docs, hard_texts):
    out = drop_copies(hard_docs)
    assert out.columns == hard_docs.columns
    rows = out.collect()
    assert Counter(norm(r.text) for r in rows) == Counter({norm(t) for _, t in hard_texts})


def test_radix_groups_and_tree():
    texts = [b"", b"a", b"a" * 40, b"a" * 41, b"a" * 40, b"", b"abcdefgh", b"abcdefghi", b"abcdefgh" * 100, b"abcdefgh" * 100]
    want = sorted(sorted(i for i, t in enumerate(texts) if t == u) for u in set(texts))
    assert sorted(sorted(g) for g in radix_groups(texts)) == want
    tree, seen = RadixTree(), {}
    for t in texts:
        entry = tree.put(t)
        assert (t in seen) == (len(entry) > 1)
        assert seen.setdefault(t, entry) is entry
        if len(entry) == 1:
            entry.append(True)


def test_heavy_prefixes_split(spark):
    docs = spark.createDataFrame([(i, "the same first line of every document " * 3 + str(i // 2)) for i in range(400)], "doc_id long, text string")
    rows = exact._rows(docs, "doc_id", "text", [])
    assert len(exact._heavy_prefixes(rows, 1 << 20, 500)) >= 2
    out = exact_dedup(docs, leaf_bytes=500).collect()
    assert all(r.group_size == 2 and r.keep_id == r.id - r.id % 2 for r in out)


def sets(texts):
    out = defaultdict(list)
    for i, t in texts:
        w = tokens(t.translate({c: c + 32 for c in range(65, 91)})) if t else []
        out[i].append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def classes(texts):
    shingles = sets(texts)
    root = {i: i for i in shingles}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(shingles, key=key)
    for a in ids:
        for b in ids:
            if key(a) < key(b) and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in shingles[a] for y in shingles[b]):
                ra, rb = sorted((find(a), find(b)), key=key)
                root[rb] = ra
    return Counter((i, len(s), find(i)) for i, many in shingles.items() for s in many)


@pytest.mark.parametrize("rounds", [8, 0])
def test_jaccard_components(hard_docs, hard_texts, rounds):
    got = Counter(tuple(r) for r in jaccard_components(hard_docs, rounds=rounds).collect())
    assert got == classes(hard_texts)


def test_jaccard_at_the_threshold(spark):
    # 36 shared shingles of 45 are 80 %, 35 of 45 are not
    a = [f"a{k}" for k in range(44)]
    texts = [(1, " ".join(a)), (2, " ".join(a[:40] + [f"b{k}" for k in range(5)])), (3, " ".join([f"c{k}" for k in range(5)] + a[4:44]))]
    got = Counter(tuple(r) for r in jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == classes(texts)


def test_any_similar_pair_shares_enough_prefix_tokens():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        base = rng.choice(10_000, n, replace=False).astype(np.uint64)
        other = base[rng.random(n) < 0.9]
        if not len(other) or 100 * len(other) < 80 * n:
            continue
        df = {int(t): int(rng.integers(1, 6)) for t in base}
        got = []
        for s in (base, other):
            s = np.sort(s)
            d = np.array([df[int(t)] for t in s])
            l, _, _ = choose_prefix(s, d, 80)
            order = np.lexsort((s, d))
            got.append((l, set(s[order[:len(s) - needed(len(s), 80) + l]].tolist())))
        assert len(got[0][1] & got[1][1]) >= min(got[0][0], got[1][0])


def test_shingle_sets_count_words_not_bytes():
    texts = [b"", b"a", b"a b", b"ab", b"a b c d e", b"A B C D E", b"a  b\tc\nd e f", "É b c d e".encode(), "é b c d e".encode()]
    s = shingle_sets(texts)
    assert [len(x) for x in s] == [0, 1, 1, 1, 1, 1, 2, 1, 1]
    assert s[4][0] == s[5][0] and s[2][0] != s[3][0] and s[7][0] != s[8][0]


def test_word_hashes_depend_on_the_word_only():
    w = split([b"x abc", b"abc", b"", b" abc  y"])
    assert w.bounds.tolist() == [0, 2, 3, 3, 5]
    assert w.hashes[1] == w.hashes[2] == w.hashes[3] and len(set(w.hashes.tolist())) == 3


@pytest.mark.parametrize("operator", [substring_dedup, exact_dedup, jaccard_components])
def test_empty_table(no_docs, operator):
    assert operator(no_docs).collect() == []


def test_all_links_between_classes(spark):
    """The whole join on unique ids: links of representatives, membership and link counts."""
    import random
    rng = random.Random(12)
    base = [f"b{k}" for k in range(120)]
    texts = [(1, None), (2, ""), (3, "one"), (4, "one"), (5, "ONE"), (6, "a b c d e")]
    for i in range(10, 60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    texts += [(60 + k, " ".join(base)) for k in range(5)]
    texts += [(100 + k, " ".join(f"r{rng.randrange(10**5)}" for _ in range(rng.randrange(3, 60)))) for k in range(30)]
    sets = {i: frozenset(s.tolist()) for (i, _), s in zip(texts, shingle_sets([(t or "").encode() for _, t in texts]))}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    reps = sorted(i for i in sets if sets[i] and first[sets[i]] == i)
    want = {(a, b) for a in reps for b in reps if a < b and near(sets[a], sets[b])}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    for block in (3, 1024):
        links, members = jaccard.jaccard_links(docs, block=block)
        links, members = links.cache(), members.cache()
        got = [tuple(r) for r in links.collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
        assert {r.id: r["class"] for r in members.collect()} == {i: first[sets[i]] if sets[i] else i for i in sets}
    counts = {r.id: r.n_links for r in jaccard.link_counts(links, members).collect()}
    assert counts == {i: sum(j != i and near(sets[i], sets[j]) for j in sets) for i in sets}
