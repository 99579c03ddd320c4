"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (FTRL-proximal) updates.

Words are runs of letters, digits and non-ASCII characters, or runs of other signs.  Each
gives four hashed features: the word, the pair with the word before, the word's shape (kind,
case, length, same as the word before) and the pair of shapes.  A document's vector is the
mean over its words, so a score is one sum of weights per document.

Training streams the sample once, in an order by hash of the id, through one task; the
sample is bounded by ``sample_rows`` and only the weights leave the task.

Inputs of the score are the words of the text only.  Defined results: null text and text
without words have the empty vector and get the score of the bias; without usable labels
every score is 0.5; repeated rows are scored alike; an empty table gives an empty result;
columns besides id and text are ignored; labels that are null or contradict each other are
settled in ``labelled``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import SAMPLE_ROWS, held_out, train_rows
from .words import _BYTE_CODE, _MULT, chunks, mix, powers

BITS = 18                      # features are hashed to 2**BITS weights
SCALE = 20.0                   # length of a document's vector of mean counts
_KIND = np.full(256, 1, np.uint8)          # 0 space, 1 sign, 2 lower case or other letter, 3 upper case, 4 digit
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = _KIND[128:] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_CLASS = np.array([0, 1, 2, 2, 2], np.uint8)


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each word as a (words, 4) matrix, word range of each document)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[buf]
    cls = _CLASS[kind]
    edge = np.flatnonzero(np.diff(cls, prepend=np.uint8(0)))
    ends = np.append(edge[1:], len(buf))
    word = cls[edge] > 0
    starts, ends = edge[word], ends[word]
    up, down = powers(len(buf) + 1, _MULT)

    def total(x):
        out = np.zeros(len(buf) + 1, x.dtype)
        np.cumsum(x, out=out[1:])
        return out[ends] - out[starts]
    size = (ends - starts).astype(np.uint64)
    code = mix(total(_BYTE_CODE[buf] * up[:len(buf)]) * down[starts] + size)
    upper = total((kind == 3).astype(np.uint64))
    case = np.where(upper == 0, 0, np.where(upper == size, 3, np.where(_KIND[buf[starts]] == 3, 1, 2))).astype(np.uint64)
    same = np.zeros(len(code), np.uint64)
    same[1:] = code[1:] == code[:-1]
    shape = cls[starts].astype(np.uint64) + case * np.uint64(4) + np.minimum(size, np.uint64(15)) * np.uint64(16) + same * np.uint64(256)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    bounds = np.searchsorted(starts, offsets)
    first = np.zeros(len(code), bool)
    first[bounds[:-1][bounds[:-1] < len(code)]] = True

    def pair(x, salt):
        before = np.where(first, np.uint64(0), np.roll(x, 1)) if len(x) else x
        return mix(x * np.uint64(3) + mix(before + np.uint64(salt)))
    shape = mix(shape + np.uint64(0x51))
    feats = np.stack([code, pair(code, 0x11), shape, pair(shape, 0x21)], axis=1)
    return (feats >> np.uint64(64 - BITS)).astype(np.int32), bounds


class Ftrl:
    """FTRL-proximal logistic regression; weights follow from z and n when needed."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """One document: ``at`` distinct features with values ``x``; the last weight is the bias."""
        at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x))))) - y) * x
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def vector(feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a document and their values."""
    at, count = np.unique(feats, return_counts=True)
    return at, SCALE * count / max(feats.size, 1)


def _train(batches):
    model = Ftrl()
    for b in batches:
        labels = b.column("label").to_pylist()
        for ks, texts in chunks(range(b.num_rows), b.column("text").cast(pa.binary()).to_pylist()):
            feats, bounds = ngrams(texts)
            for j, k in enumerate(ks):
                model.learn(*vector(feats[bounds[j]:bounds[j + 1]].ravel()), float(labels[k] > 0))
    yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights().astype("<f4").tobytes()], pa.binary())})


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights and bias, from at most about ``sample_rows`` labelled rows."""
    rows = train_rows(docs, labels, label_col, id_col, text_col, sample_rows)
    stream = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "label")
    found = stream.mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(bytes(found[0].weights), "<f4").copy() if found else np.zeros((1 << BITS) + 1, "<f4")


def _score(weights):
    def run(batches):
        for b in batches:
            score = []
            for _, texts in chunks(range(b.num_rows), b.column("text").cast(pa.binary()).to_pylist()):
                feats, bounds = ngrams(texts)
                total = np.zeros(len(feats) + 1)
                np.cumsum(weights[feats].sum(axis=1, dtype=np.float64), out=total[1:])
                n = np.diff(bounds)
                margin = weights[-1] + SCALE * (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(4 * n, 1)
                score.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(np.concatenate(score) if score else [], pa.float64())],
                                             names=["id", "held_out", "score"])
    return run


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_score(weights), "id long, held_out boolean, score double")
