import random

import pytest
from pyspark.sql import Row

SF = "/root/testdata/sf0.001"
EXTRA = ("id", "row", "rep", "shard", "payload", "kept", "score", "held_out", "label", "window", "cell", "rank", "piece", "words", "hits")


def words(rng, n, vocabulary=60):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def hard_texts():
    """(doc_id, text): null and empty texts, copies, near copies, shared passages, a long text,
    repeated rows, a null id, separators only, non-ASCII text."""
    rng = random.Random(7)
    base = words(rng, 300, 10_000)
    passage = words(rng, 70, 10_000)
    out = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "One"), (6, "a b c d"), (7, "A b c D"), (8, "a b c d e")]
    for i in range(10, 30):
        w = list(base)
        for _ in range(i - 10):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    for i in range(30, 50):
        out.append((i, " ".join(words(rng, rng.randrange(5, 200), 10_000) + passage + words(rng, 40, 10_000))))
    out += [(50 + i, " ".join(base[:120])) for i in range(12)]
    out += [(70, "  ".join(base[:120])), (71, " ".join(base[:120]) + "\n")]
    out += [(80, " ".join(words(rng, 20_000, 100_000))), (81, "naïve Été \U0001f600 Kelvin İx"), (82, "the " * 400), (83, "the " * 399)]
    out += [(90, "same row twice"), (90, "same row twice"), (91, "same id"), (91, "other text"), (None, "no id"), (None, " ".join(base[:120]))]
    return out


@pytest.fixture(scope="session")
def hard_docs(spark, hard_texts):
    rows = [Row(**{"doc_id": i, "text": t, **{c: f"{c}{k}" for c in EXTRA}}) for k, (i, t) in enumerate(hard_texts)]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
