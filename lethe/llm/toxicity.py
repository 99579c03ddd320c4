"""Toxicity with Levenshtein automata over a lexicon trie.

1. Lexicon: words and word beginnings that set toxic training documents apart, found from
   the training rows alone; without usable labels a short list of English insults serves.
2. The lexicon trie is intersected with the Levenshtein automaton of distance 1 and made
   deterministic, so one table look-up a letter finds exact and misspelled terms; a swap of
   two neighbouring letters is one error.  Word beginnings are matched exactly; the whole
   words that a chosen term made superfluous are matched with errors and count for that term.
   Words under 5 bytes match without errors.  All words of a chunk of documents step together.
3. Around each find a context window tells quotation (open quote marks, words such as
   "said" or "called") from use; finds in quotation are features of their own.
4. A logistic regression on the finds gives the score.

Inputs of the score are the words of the text only.  Defined results: null and empty texts
are scored like any text without finds; repeated rows are scored alike; an empty table
gives an empty result; columns besides id and text are ignored; labels that are null or
contradict each other are settled in ``labelled``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import SAMPLE_ROWS, held_out, train_rows
from .words import chunks, split

# Used when no labels can be learned from.
SEED_TERMS = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "scum", "loser", "trash", "clown")
MAX_TERMS = 200                # lexicon size
_PREFIXES = range(4, 9)        # letters of a word beginning
_FUZZY_LEN = 5                 # bytes from which a whole word also matches with one error
_FUZZY = 0.7                   # weight of a find with one error
_AROUND = 80                   # bytes of context on either side
_QUOTES = (('"'.encode(),) * 2, ("“".encode(), "”".encode()), ("«".encode(), "»".encode()), ("„".encode(), "“".encode()))
_CUES = re.compile(rb"\b(said|says|wrote|writes|quoted?|called|calls|term|word|dijo|dit|sagte)\b\W*(\w+\W+){0,4}$", re.I)
_TERM = re.compile(r"[^\W_]+")


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte Latin-1 letters."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    latin = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1
    out[latin] += 32
    return out


class LexiconAutomaton:
    """Trie of terms x Levenshtein automaton of ``edits``, as a deterministic table.

    A state is the set of (trie node, errors so far) that the letters read can have reached.
    With ``prefix`` a term is found as soon as the word begins with it; with ``swaps`` two
    neighbouring letters in the other order are one error (a state then also holds (node,
    letter): the letter after next was read first).
    """

    def __init__(self, terms: list[bytes], edits: int, prefix: bool = False, swaps: bool = False):
        self.prefix, self.longest = prefix, max(map(len, terms), default=0) + edits
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for k, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            ends.setdefault(node, k)
        letters = sorted({c for t in terms for c in t})
        self.symbol = np.zeros(256, np.int64)
        self.symbol[letters] = np.arange(1, len(letters) + 1)

        def closed(reach: dict) -> frozenset:
            todo = [node for node in reach if isinstance(node, int)]
            while todo:                        # letters of the term that the word leaves out
                node = todo.pop()
                if reach[node] < edits:
                    for child in children[node].values():
                        if reach.get(child, 99) > reach[node] + 1:
                            reach[child] = reach[node] + 1
                            todo.append(child)
            return frozenset(reach.items())

        def step(state, c):
            reach: dict = {}

            def add(node, e):
                if e <= edits and reach.get(node, 99) > e:
                    reach[node] = e
            for node, e in state:
                if not isinstance(node, int):  # the skipped letter must follow
                    child = children[node[0]].get(c)
                    if child is not None and node[1] in children[child]:
                        add(children[child][node[1]], e)
                    continue
                add(node, e + 1)               # a letter too many
                for letter, child in children[node].items():
                    add(child, e + (letter != c))
                    if swaps and letter != c and c in children[child]:
                        add((node, c), e + 1)
            return closed(reach)
        start = closed({0: 0})
        number, order, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        at = 0
        while at < len(order):
            row = []
            for c in (None, *letters):
                to = step(order[at], c) if order[at] else order[0]
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
            at += 1
        self.table = np.array(rows, np.int32)
        self.term = np.full(len(order), -1, np.int32)
        self.errors = np.zeros(len(order), np.int8)
        for s, state in enumerate(order):
            found = min(((e, ends[node]) for node, e in state if node in ends), default=None)
            if found:
                self.errors[s], self.term[s] = found

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(word, term, errors) of the words buf[start:end] that hold a term."""
        word = np.arange(len(starts))
        if not self.prefix:
            word = word[ends - starts <= self.longest]
        state, at, out = np.ones(len(word), np.int32), starts[word], []

        def report(which):
            hit = which & (self.term[state] >= 0)
            out.append((word[hit], self.term[state[hit]], self.errors[state[hit]]))
            return hit
        for _ in range(self.longest + 1):
            over = at == ends[word]
            gone = (report(over) | over) if not self.prefix else (report(np.ones(len(word), bool)) | over)
            live = ~gone
            word, state, at = word[live], state[live], at[live]
            if not len(word):
                break
            state = self.table[state, self.symbol[buf[at]]]
            live = state > 0
            word, state, at = word[live], state[live], at[live] + 1
        return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.int64),) * 3


def quoted(before: bytes, after: bytes) -> bool:
    """The find stands in quotation: inside open quote marks, or after a word of reporting."""
    for left, right in _QUOTES:
        if left == right:
            if before.count(left) % 2 and right in after:
                return True
        elif before.rfind(left) > before.rfind(right) and right in after:
            return True
    return bool(_CUES.search(before))


class Finder:
    """Features of a text: per term the finds in use and in quotation, and totals.

    ``covered`` has whole words that count for another term: (word, place of the term in
    ``words`` + ``prefixes``).
    """

    def __init__(self, words: list[str], prefixes: list[str], covered: list[tuple[str, int]] = ()):
        self.n = len(words) + len(prefixes)
        term = [*range(len(words)), *(t for _, t in covered)]
        coded = [w.encode() for w in [*words, *(w for w, _ in covered)]]
        long_ = [k for k, w in enumerate(coded) if len(w) >= _FUZZY_LEN]
        short = [k for k, w in enumerate(coded) if len(w) < _FUZZY_LEN]
        self.parts = [(np.array(ks), LexiconAutomaton(ts, e, p, swaps=e > 0)) for ks, ts, e, p in (
            (list(range(len(words), self.n)), [p.encode() for p in prefixes], 0, True),
            ([term[k] for k in long_], [coded[k] for k in long_], 1, False),
            ([term[k] for k in short], [coded[k] for k in short], 0, False)) if ks]

    def features(self, texts: list[bytes]) -> list[dict[int, float]]:
        """Sparse features: 2t and 2t + 1 for term t in use and in quotation, 2n for all."""
        w = split(texts, alnum=True)
        buf, raw = fold(w.buf), w.buf.tobytes()
        out: list[dict[int, float]] = [{} for _ in texts]
        counted: set[tuple[int, int]] = set()
        for ks, machine in self.parts:
            word, term, errors = machine.find(buf, w.starts, w.ends)
            doc = np.searchsorted(w.bounds, word, side="right") - 1
            for i, t, e, d in zip(word.tolist(), ks[term].tolist(), errors.tolist(), doc.tolist()):
                if (i, t) in counted:          # by the word beginning already
                    continue
                if machine.prefix:
                    counted.add((i, t))
                a, b = int(w.starts[i]), int(w.ends[i])
                first, last = int(w.starts[w.bounds[d]]), int(w.ends[w.bounds[d + 1] - 1])
                q = quoted(raw[max(first - 4, a - _AROUND, 0):a], raw[b:min(last + 4, b + _AROUND)])
                f = out[d]
                f[2 * t + q] = f.get(2 * t + q, 0.0) + _FUZZY ** e
        size = np.diff(w.bounds).tolist()
        for f, n in zip(out, size):
            plain = sum(v for k, v in f.items() if k % 2 == 0)
            said = sum(v for k, v in f.items() if k % 2)
            for k in f:
                f[k] = math.log1p(f[k])
            f[2 * self.n] = math.log1p(plain)
            f[2 * self.n + 1] = math.log1p(100 * plain / max(n, 20))
            f[2 * self.n + 2] = math.log1p(said)
        return out


def _count_terms(batches):
    """(term, toxic documents, other documents) per batch; a term ending in $ is a whole word."""
    for b in batches:
        count: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
            words = set(_TERM.findall(text.lower()))
            terms = {w + "$" for w in words if 3 <= len(w) <= 30}
            for n in _PREFIXES:
                terms.update(w[:n] for w in words if len(w) > n)
            count[bool(label)].update(terms)
        terms = list(count[0] | count[1])
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "toxic": pa.array([count[1][t] for t in terms], pa.int64()),
                                          "clean": pa.array([count[0][t] for t in terms], pa.int64())})


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str], list[tuple[str, int]]]:
    """(words, word beginnings) that stand in toxic documents far more often than in others,
    and the whole words that one of them begins or that begin one, with its place."""
    p, q = F.col("toxic") / n_toxic, F.col("clean") / n_clean
    both = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / n_toxic + 1 / n_clean) + 1e-12)
    best = (rows.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter((F.col("toxic") >= 5) & (p > 3 * q))
            .withColumn("z", F.round(z, 6)).filter("z > 5")
            .orderBy(F.desc("z"), F.desc(F.length("term")), "term").limit(20 * MAX_TERMS).collect())
    chosen: list[str] = []
    covered: list[tuple[str, str]] = []
    for r in best:
        t = r.term.rstrip("$")
        by = next((c for c in chosen if t.startswith(c.rstrip("$")) or c.rstrip("$").startswith(t)), None)
        if by is not None and r.term[-1] == "$":
            covered.append((t, by))
        elif by is None and len(chosen) < MAX_TERMS:
            chosen.append(r.term)
    words, prefixes = [c for c in chosen if c[-1] == "$"], [c for c in chosen if c[-1] != "$"]
    place = {c: k for k, c in enumerate(words + prefixes)}
    return [c[:-1] for c in words], prefixes, [(t, place[by]) for t, by in covered]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the unpenalised constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), grad)
        w -= move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return w


def _apply(finder: Finder, weights: np.ndarray):
    """Scores of Arrow batches (id, held_out, text)."""
    def run(batches):
        for b in batches:
            score = []
            for _, texts in chunks(range(b.num_rows), b.column("text").cast(pa.binary()).to_pylist()):
                for f in finder.features(texts):
                    score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, weights[-1] + sum(weights[k] * v for k, v in f.items()))))))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(score, pa.float64())], names=["id", "held_out", "score"])
    return run


def _clean_rows(finder: Finder, weights: np.ndarray, threshold: float, text_col: str):
    """Batches without the rows whose score reaches the threshold, all columns kept."""
    scored = _apply(finder, weights)

    def run(batches):
        for b in batches:
            text = pa.array([t or "" for t in b.column(text_col).to_pylist()], pa.string())
            none = pa.nulls(b.num_rows, pa.int64())
            score = next(scored([pa.RecordBatch.from_arrays([none, none, text], names=["id", "held_out", "text"])])).column("score").to_numpy()
            yield b.filter(pa.array(score < threshold))
    return run


def _sparse(finder: Finder):
    def run(batches):
        for b in batches:
            rows = []
            for _, texts in chunks(range(b.num_rows), b.column("text").cast(pa.binary()).to_pylist()):
                rows += finder.features(texts)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([list(f) for f in rows], pa.list_(pa.int32())),
                                              pa.array([list(f.values()) for f in rows], pa.list_(pa.float64()))], names=["id", "label", "k", "v"])
    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 sample_rows: int = SAMPLE_ROWS) -> tuple[Finder, np.ndarray]:
    """Lexicon and weights from at most about ``sample_rows`` labelled rows."""
    rows = train_rows(docs, labels, label_col, id_col, text_col, sample_rows)
    n = dict(map(tuple, rows.groupBy("label").count().collect()))
    if not n.get(1) or not n.get(0):
        finder = Finder(list(SEED_TERMS), [])
        weights = np.zeros(2 * finder.n + 4)
        weights[[2 * finder.n, -1]] = 4.0, -3.0
        return finder, weights
    finder = Finder(*learn_lexicon(rows, n[1], n[0]))
    sample = rows.mapInArrow(_sparse(finder), "id long, label int, k array<int>, v array<double>").orderBy("id", "label", "k", "v").collect()
    x = np.zeros((len(sample), 2 * finder.n + 3))
    for i, r in enumerate(sample):
        x[i, r.k] = r.v
    return finder, fit_logistic(x, np.array([float(r.label) for r in sample]))


def score_toxicity(docs: DataFrame, finder: Finder, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_apply(finder, weights), "id long, held_out boolean, score double")


def drop_toxic(docs: DataFrame, finder: Finder, weights: np.ndarray, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents whose score stays under the threshold, with all their columns."""
    return docs.mapInArrow(_clean_rows(finder, weights, threshold, text_col), docs.schema)
