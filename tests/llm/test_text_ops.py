"""License scan, toxicity, quality and decontamination against brute force and held-out accuracy."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from lethe.llm.decontaminate import Benchmark, LengthIndex, _NEAR, benchmark_hits, drop_contaminated, fingerprints
from lethe.llm.labelled import train_rows
from lethe.llm.licenses import BASE, NOTICES, license_scan, rare_token_index, _templates
from lethe.llm.quality import BITS, Ftrl, fit_quality, ngrams, score_quality, vector
from lethe.llm.toxicity import Finder, LexiconAutomaton, drop_toxic, fit_toxicity, learn_lexicon, quoted, score_toxicity
from lethe.llm.words import split

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def file_words(text):
    return WORD.findall((text or "").translate(LOWER))


# --- license scan

def base_places(text):
    w, out = file_words(text), []
    for phrase, label in BASE:
        p = phrase.split()
        out += [(label, i) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return sorted(out)


LICENSES = [(1, "GNU General Public License, CC-BY; mit license MIT-License"), (2, None), (3, ""), (4, "cc by " * 3000), (5, "ccby cc/by/cc by"),
            (6, "gnu general public licence"), (7, "Élicense apache LICENSE licenseé"), (8, "x " + NOTICES[8][1].upper() + " y"),
            (9, NOTICES[8][1].replace("documentation files", "docs")), (10, "apache license apache license"), (11, "MIT LICENSE"), (11, "MIT LICENSE"),
            (12, "apacKe license K"), (13, "gnu gnu general general public public license"), (None, "the mit license")]


def test_license_places(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in LICENSES], "doc_id long, text string, words string, hits string")
    rows = license_scan(docs).collect()
    got = Counter((r.id, r.n_words, tuple(sorted((m.label, m["first"]) for m in r.matches if m.base))) for r in rows)
    assert got == Counter((i, len(file_words(t)), tuple(base_places(t))) for i, t in LICENSES)
    labels = {r.id: {m.label: m.score for m in r.matches if not m.base} for r in rows}
    assert labels[8] == {"mit-notice": 1.0} and 0.8 <= labels[9]["mit-notice"] < 1 and not labels[6]


def test_license_index_has_the_rarest_words():
    templates = _templates()
    df = Counter({w: 100 for t in templates for w in t[1]}) | {"mit": 3}
    df.update({"apache": -99})
    index = rare_token_index(templates, df)
    assert {t for t, _ in index["mit"]} >= {3} and {t for t, _ in index["apache"]} >= {1}
    assert all(any(t == k for places in index.values() for t, _ in places) for k in range(len(templates)))


def notice_labels(text):
    """Notices at every start, without anchors: label -> best score."""
    w, out = file_words(text), {}
    for label, words, at, key, base in _templates():
        for s in range(-len(words) + 1, len(w)):
            same = sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(words))
            if not base and s + at >= 0 and w[s + at:s + at + len(key)] == key and same >= 0.8 * len(words):
                out[label] = max(out.get(label, 0), same / len(words))
    return out


def test_notices_do_not_depend_on_the_rest_of_the_corpus(spark):
    rng = random.Random(4)
    texts = []
    for label, words, at, key, base in _templates():
        free = [j for j in range(len(words)) if not at <= j < at + len(key)]
        spare = int(0.2 * len(words) + 1e-9)
        for _ in range(3):
            w = list(words)
            for j in rng.sample(free, min(spare, len(free))):
                w[j] = "zz"
            texts.append(" ".join(["aa", *w, "bb"]))
    def scan(some):
        rows = license_scan(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()
        return {r.id: {m.label: m.score for m in sorted(r.matches, key=lambda m: m.score) if not m.base} for r in rows}
    bsd = next(words for label, words, *_ in _templates() if label == "bsd")
    alone = " ".join("zz" if x in ("conditions", "following", "met") else x for x in bsd)       # words of df 0
    assert notice_labels(alone).keys() == {"bsd"} and scan([alone])[0] == notice_labels(alone)
    assert scan(texts) == {i: notice_labels(t) for i, t in enumerate(texts)}


def test_license_empty_table(no_docs):
    assert license_scan(no_docs).collect() == []


# --- toxicity

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = [b"abcab", b"abbba", b"caabc", b"aaaaaa", b"bacab"]
    found = set()
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + [t for t in terms]
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = ends - [len(t) for t in texts]
    for edits in (0, 1, 2):
        word, term, errors = LexiconAutomaton(terms, edits).find(buf, starts, ends)
        got = dict(zip(word.tolist(), errors.tolist()))
        want = {i: min(distance(t, u) for u in terms) for i, t in enumerate(texts)}
        assert got == {i: d for i, d in want.items() if d <= edits}
        assert all(distance(texts[w], terms[t]) == e for w, t, e in zip(word.tolist(), term.tolist(), errors.tolist()))
        found |= set(got)
    word, term, _ = LexiconAutomaton([b"abc", b"ca"], 0, True).find(buf, starts, ends)
    assert sorted(word.tolist()) == [i for i, t in enumerate(texts) if t.startswith((b"abc", b"ca"))]


def swap_distance(a, b):
    """Edit distance in which a swap of neighbours is one error."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_counts_a_swap_as_one_error():
    rng = random.Random(3)
    terms = [b"abcab", b"abbba", b"caabc", b"aaaaaa", b"bacab"]
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + terms
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    for edits in (0, 1, 2):
        word, _, errors = LexiconAutomaton(terms, edits, swaps=True).find(buf, ends - [len(t) for t in texts], ends)
        want = {i: min(swap_distance(t, u) for u in terms) for i, t in enumerate(texts)}
        assert dict(zip(word.tolist(), errors.tolist())) == {i: d for i, d in want.items() if d <= edits}


def test_lexicon_with_inflected_forms_still_finds_misspelled_words(spark):
    toxic = ["you idiot"] * 30 + ["idiots all"] * 6 + ["an idiotic one"] * 5
    rows = spark.createDataFrame([(1, t) for t in toxic] + [(0, f"plain words {k}") for k in range(200)], "label int, text string")
    words, prefixes, covered = learn_lexicon(rows, len(toxic), 200)
    assert prefixes and all("idiot".startswith(p) for p in prefixes) and "idiot" in dict(covered)
    finder = Finder(words, prefixes, covered)
    t = dict(covered)["idiot"]
    texts = [b"idiot", b"idiots", b"ediot", b"idjot", b"idoit", b"idjots", b"plain"]
    use = [f.get(2 * t, 0.0) for f in finder.features(texts)]
    assert np.allclose(use, np.log1p([1, 1, 0.7, 0.7, 0.7, 0.7, 0]))


def test_context_window():
    assert quoted(b'he wrote "you ', b' fool" to me') and not quoted(b'"ok" you ', b' "fine"')
    assert quoted("sagt „du ".encode(), "“ oft".encode()) and quoted(b"the so called ", b" thing") and not quoted(b"you are an ", b" sir")


def test_finder_counts_use_and_quotation():
    f = Finder(["moron", "scum"], ["lowe"]).features([b"you MORON, morn morom", b'he said "moron"', b"loweich lowe low", b""])
    assert f[0].keys() >= {0} and 1 not in f[0] and f[1].keys() >= {1} and f[2].keys() >= {4} and not any(f[3].values())


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(5)
    plain = [f"word{k}" for k in range(500)]
    docs, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                t = rng.choice(["zorkel", "blimfart", "gronkus"])
                w.insert(rng.randrange(len(w)), t if i % 3 else t[:2] + "x" + t[3:])
        junk = i % 5 == 0
        text = " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w) + "."
        docs.append((i, text, "en", "s"))
        labels.append((i, int(not junk), int(bad)))
    labels += [(3, None, None), (None, 1, 1), (5000, 0, 1), (8, 1, 1)]
    docs += [(2000, None, "en", "s"), (2001, "", None, None), (None, "no id", "x", "y"), (2002, "zorkel", "x", "y"), (2002, "zorkel", "x", "y")]
    return (spark.createDataFrame(docs, "doc_id long, text string, label string, score string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def crc_held(i):
    import zlib
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_held_out(rated):
    docs, labels = rated
    model = fit_toxicity(docs, labels)
    rows = score_toxicity(docs, *model).collect()
    assert Counter(r.id for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert all(r.held_out == crc_held(r.id) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and r.id < 1200]
    assert np.mean([(r.score >= 0.3) == (r.id % 8 == 0) for r in test]) > 0.97
    again = {r.id: r.score for r in score_toxicity(docs, *fit_toxicity(docs, labels)).collect()}
    assert all(abs(again[r.id] - r.score) < 1e-9 for r in rows)
    kept = drop_toxic(docs, *model)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.id for r in rows if r.score < 0.3)


def test_labels_of_held_out_rows_do_not_matter(rated, spark):
    docs, labels = rated
    other = spark.createDataFrame([(r.doc_id, 1 - r.quality if crc_held(r.doc_id) else r.quality, 1 - r.toxic if crc_held(r.doc_id) else r.toxic)
                                   for r in labels.filter("quality is not null").collect()], labels.schema)
    for fit, score in ((fit_toxicity, score_toxicity), (lambda *a: (fit_quality(*a),), score_quality)):
        a, b = ({r.id: r.score for r in score(docs, *fit(docs, x)).collect()} for x in (labels, other))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_sample_is_bounded(rated):
    docs, labels = rated
    assert 30 < train_rows(docs, labels, "toxic", "doc_id", "text", 100).count() < 200


def test_without_labels(rated):
    docs, labels = rated
    none = labels.filter("false")
    assert {r.score for r in score_quality(docs, fit_quality(docs, none)).collect()} == {0.5}
    finder, weights = fit_toxicity(docs, none)
    s = {r.id: r.score for r in score_toxicity(docs, finder, weights).collect()}
    assert s[2000] < 0.1
    assert fit_toxicity(docs, labels)[0].n >= 3


# --- quality

def test_quality_held_out(rated):
    docs, labels = rated
    rows = score_quality(docs, fit_quality(docs, labels)).collect()
    assert Counter(r.id for r in rows) == Counter(r.doc_id for r in docs.collect())
    test = [r for r in rows if r.held_out and r.id is not None and r.id < 1200]
    assert np.mean([(r.score >= 0.7) == (r.id % 5 != 0) for r in test]) > 0.95


def test_score_is_the_sparse_dot_product():
    feats, bounds = ngrams([b"a b  c!!", b"", b"a b c!!", "é É".encode()])
    assert bounds.tolist() == [0, 4, 4, 8, 10] and (feats[:4] == feats[4:8]).all() and feats.max() < 1 << BITS
    at, x = vector(feats[:4].ravel())
    w = np.random.default_rng(0).normal(size=1 << BITS)
    assert np.isclose(w[at] @ x, 20 * w[feats[:4]].mean())


def test_ftrl_learns_and_stays_sparse():
    m = Ftrl()
    for k in range(400):
        m.learn(np.array([k % 2, 2]), np.array([1.0, 1.0]), float(k % 2))
    w = m.weights()
    assert w[1] > 0.5 and w[0] < -0.5 and np.count_nonzero(w) <= 4


def test_classifiers_on_empty_table(no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_quality(no_docs, fit_quality(no_docs, labels)).collect() == []
    assert score_toxicity(no_docs, *fit_toxicity(no_docs, labels)).collect() == []


# --- decontamination

def shingles(w):
    return [tuple(w[k:k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def best_similarity(doc, item):
    b, n, best = Counter(shingles(item)), len(item), 0
    if not n:
        return 0
    for s in range(len(doc) - n + 1):
        a = Counter(shingles(doc[s:s + n]))
        both = sum((a & b).values())
        best = max(best, both / (2 * sum(b.values()) - both))
    return best


def test_benchmark_hits(spark):
    rng = random.Random(11)
    items = [(k, " ".join(f"q{rng.randrange(300)}" for _ in range(rng.choice([14, 20, 33, 60])))) for k in range(30)]
    items += [(100, None), (101, "..."), (102, "only three words"), (103, items[0][1]), (None, "the null item has six words"), (104, "a a a a a a a a a a a a a a")]
    docs = [(1, None), (2, ""), (3, "Only THREE, words!"), (4, "only three"), (5, "a " * 300), (6, "The null item has six words")]
    for i in range(10, 90):
        w = [f"d{rng.randrange(2000)}" for _ in range(rng.randrange(0, 80))]
        part = items[rng.randrange(30)][1].split()
        for _ in range(rng.randrange(0, 3)):
            part[rng.randrange(len(part))] = "zz"
        docs.append((i, (" ".join(w) + " " + " ".join(part)).upper() + ". " + " ".join(w[:7])))
    docs += [(None, items[1][1]), (91, items[2][1]), (91, items[2][1])]
    df = spark.createDataFrame([(i, t, "h", "f") for i, t in docs], "doc_id long, text string, hamming string, id string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.id, r.item_id, round(r.similarity, 9)) for r in benchmark_hits(df, it).collect())
    want = Counter()
    for i, t in docs:
        for k, u in items:
            s = best_similarity(file_words(t), file_words(u))
            if s >= 0.8:
                want[i, k, round(s, 9)] += 1
    assert got == want and len(want) > 40
    clean = drop_contaminated(df, it)
    assert clean.columns == df.columns
    bad = {(i, t) for i, t in docs if any(best_similarity(file_words(t), file_words(u)) >= 0.8 for _, u in items)}
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(d for d in docs if d not in bad)


def whole_similarity(doc, item):
    """Similarity of a document with fewer words than the item, as its one window."""
    a, b = Counter(shingles(doc)) if len(doc) >= 5 else Counter(), Counter(shingles(item))
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(12)
    items = [(k, " ".join(f"q{rng.randrange(200)}" for _ in range(n))) for k, n in enumerate([9, 10, 14, 15, 20, 33, 40, 59] * 3)]
    items += [(100, items[6][1]), (101, "a " * 40), (102, "only three words"), (None, "the null item has all of nine words here")]
    docs = [(1, "only three"), (2, "a " * 35), (3, "a " * 31), (4, ""), (5, None), (6, "the null item has all of nine words")]
    for k, text in items[:24]:
        w = text.split()
        for cut in (1, 2, 3, 4, 6, 8, 12):
            first = rng.randrange(cut + 1)
            part = w[first:len(w) - cut + first]
            if part and cut % 3 == 2:
                part[rng.randrange(len(part))] = "zz"
            docs.append((1000 + 20 * k + cut, " ".join(part).upper() + "."))
    docs += [(None, items[7][1].rsplit(" ", 1)[0])] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.id, r.item_id, r.first_word, r.n_words, round(r.similarity, 9)) for r in benchmark_hits(df, it).collect()
                  if r.n_words < len(dict(items)[r.item_id].split()))
    want, bad = Counter(), Counter()
    for i, t in docs:
        w = file_words(t)
        for k, u in items:
            v = file_words(u)
            s = whole_similarity(w, v) if len(w) < len(v) else 0
            if s >= 0.8:
                want[i, k, 0, len(w), round(s, 9)] += 1
            if max(s, best_similarity(w, v)) >= 0.8:
                bad[i, t] = 1
    assert got == want and len(want) > 60
    assert Counter((r.doc_id, r.text) for r in drop_contaminated(df, it).collect()) == Counter(d for d in docs if d not in bad)


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(2)
    bench = Benchmark([(k, " ".join(f"w{rng.integers(50)}" for _ in range(24)).encode()) for k in range(40)], 5, 80)
    index = bench.lengths[24]
    prints = index.prints[rng.integers(0, 40, 300)].copy()
    for row in prints:
        for f in range(2):
            for bit in rng.choice(64, rng.integers(0, 30), replace=False):
                row[f] ^= np.uint64(1) << np.uint64(bit)
    w, i, d = index.candidates(prints)
    dist = np.bitwise_count(prints[:, None, :] ^ index.prints[None, :, :]).min(axis=2)
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(dist <= 16))))
    assert _NEAR.sum(axis=1).tolist() == [37] * 256 and fingerprints(np.empty((0, 3), np.uint64)).shape == (0, 2)


def test_typographic_marks_separate_words(spark):
    finder = Finder(["idiot"], [])
    marked = ["“idiot”", "«idiot»", "idiot—", "so…idiot…so", "¡idiot!", "idiot\u00a0you", "‘idiot’", "¿idiot‽"]
    for text in marked:
        f = finder.features([text.encode()])[0]
        assert f.get(0, f.get(1)) == pytest.approx(np.log1p(1)), text
    assert 1 in finder.features(["he said “idiot”".encode()])[0]
    w = split(["1ª vez, nº2 µm ½ naïve — x²".encode(), "a‐b\u2003c".encode()], alnum=True)
    assert [bytes(w.buf[a:b]).decode() for a, b in zip(w.starts, w.ends)] == ["1ª", "vez", "nº2", "µm", "½", "naïve", "x²", "a", "b", "c"]
    item = [f"item{k}" for k in range(24)]
    printed = "“" + "” — “".join(" ".join(item[k:k + 3]) + "…" for k in range(0, 24, 3)) + "”"
    hits = benchmark_hits(spark.createDataFrame([(1, "before " + printed + " after")], "doc_id long, text string"),
                          spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(h.item_id, h.similarity) for h in hits] == [(7, 1.0)]


def test_many_items_of_one_length_in_bounded_memory():
    import tracemalloc
    rng = np.random.default_rng(3)
    index = LengthIndex(list(range(50_000)), rng.integers(0, 1 << 63, (50_000, 20), dtype=np.uint64))
    prints = index.prints[rng.integers(0, 50_000, 200)]
    tracemalloc.start()
    w, i, d = index.candidates(prints)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and set(range(200)) <= set(w[d == 0].tolist())


def test_decontamination_empty_tables(no_docs, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "x y z")], "doc_id long, text string")
    assert benchmark_hits(no_docs, items).collect() == [] and benchmark_hits(some, items).collect() == []
    assert drop_contaminated(some, items).count() == 1
