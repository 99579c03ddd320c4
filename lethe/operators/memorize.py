"""Memorisation analytics over a character model held in Spark tables.

The recurrent network of the original work is replaced by an order-k character
model: ``counts(ctx, next, n)`` from stride-1 windows (a partial aggregate over
the whole corpus) with additive smoothing,

    p(c | ctx) = (n(ctx, c) + alpha) / (n(ctx) + alpha * V)      (unseen ctx -> 1 / V)

so perplexity, exposure and greedy completion are joins against that table, and
removing text from the model is exact: subtract its window counts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rand import phash, uniform
from ..session import cut_lineage
from . import features as fe

# The canary sentence, its start and the secret number.
CANARY_FMT = "`my telephone number is {}!' said alice.\n\n  "
CANARY_START = "`my telephone number is "
CANARY_NUMBER = "0123456789"
CANARY_REPLACEMENT = "x" * len(CANARY_NUMBER)   # unlearning writes it over the secret


def corpus(docs: DataFrame, canary: str | None, n: int, seed=42, pattern: str = "\n", offset: int = 1,
           key: str = "doc_id") -> DataFrame:
    """(key, text): canary inserted at n seeded breaks of every text, then lower-cased."""
    d = docs.select(key, "text")
    if canary:
        d = fe.insert_canary(d, key, canary, n, seed, pattern, offset).select(key, "text")
    return d.withColumn("text", F.lower("text"))


# Characters coded at once, distinct windows a task holds, rows of an Arrow batch.
STEP_CHARS, HELD_GRAMS, BATCH_ROWS = 1 << 21, 1 << 20, 1 << 17
TABLE_BITS = 22                # windows of no more bits are counted in a table instead of by sorting


def _pieces(batches, k: int):
    """(code points, starts of the windows of k + 1) of the batches' texts, some STEP_CHARS at a time.
    A longer text comes in pieces that overlap by k."""
    def packed(texts):
        ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.flatnonzero(np.arange(len(ends)) + k < ends)
    held, size = [], 0
    for b in batches:
        for text in b.column("text").to_pylist():
            for at in range(0, len(text or "") - k, STEP_CHARS):
                held.append(text[at:at + STEP_CHARS + k])
                size += len(held[-1])
                if size >= STEP_CHARS:
                    yield packed(held)
                    held, size = [], 0
    if held:
        yield packed(held)


def kgram_counts(texts: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """counts(ctx, next, n) over every window of every text.

    A task counts its windows as numbers, the characters' places in the task's alphabet side by
    side, and sends its partial counts; where the alphabet is too large for that, as strings.
    """
    bits = 63 // (k + 1)

    def strings(codes, n):
        import pyarrow as pa
        for at in range(0, len(n), BATCH_ROWS):
            whole = codes[at:at + BATCH_ROWS].astype("<u4").tobytes().decode("utf-32-le")
            cuts = range(0, len(whole), k + 1)
            yield pa.RecordBatch.from_arrays([pa.array([whole[i:i + k] for i in cuts], pa.string()), pa.array([whole[i + k] for i in cuts], pa.string()),
                                              pa.array(n[at:at + BATCH_ROWS], pa.int64())], names=["ctx", "next", "n"])

    def run(batches):
        place, alphabet = np.full(0x110000, -1, np.int64), np.empty(0, np.uint32)
        grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def held():
            return strings(alphabet[np.stack([grams >> (bits * j) & ((1 << bits) - 1) for j in range(k, -1, -1)], axis=1)], counts)
        for codes, starts in _pieces(batches, k):
            ids = place[codes]
            fresh = np.unique(codes[ids < 0])
            if len(alphabet) + len(fresh) > 1 << bits:
                rows, n = np.unique(np.lib.stride_tricks.sliding_window_view(codes, k + 1)[starts], axis=0, return_counts=True)
                yield from strings(rows, n)
                continue
            if len(fresh):
                place[fresh] = np.arange(len(alphabet), len(alphabet) + len(fresh))
                alphabet = np.concatenate([alphabet, fresh])
                ids = place[codes]
            short = max(len(alphabet) - 1, 1).bit_length()
            few = short * (k + 1) <= TABLE_BITS
            number = np.zeros(len(starts), np.int64)
            for j in range(k + 1):
                number = number << (short if few else bits) | ids[starts + j]
            if few:
                n = np.bincount(number)
                found = np.flatnonzero(n)
                n, found = n[found], sum((found >> (short * j) & ((1 << short) - 1)) << (bits * j) for j in range(k + 1))
            else:
                found, n = np.unique(number, return_counts=True)
            both = np.concatenate([grams, found])
            order = np.argsort(both, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(both[order]) > 0]))
            grams, counts = both[order][first], np.add.reduceat(np.concatenate([counts, n])[order], first)
            if len(grams) > HELD_GRAMS:
                yield from held()
                grams, counts = grams[:0], counts[:0]
        if len(grams):
            yield from held()
    parts = texts.select("text").mapInArrow(run, "ctx string, next string, n long")
    return parts.groupBy("ctx", "next").agg(F.sum("n").alias("n"))


def counts_for(texts: DataFrame, k: int, asked: DataFrame, key: str = "doc_id") -> DataFrame:
    """counts(ctx, next, n) of the asked contexts only."""
    return asked_counts(texts, k, asked)[0]


def asked_counts(texts: DataFrame, k: int, asked: DataFrame) -> tuple[DataFrame, int]:
    """(counts(ctx, next, n) of the asked contexts, number of characters in use), in one pass.

    The asked contexts are the caller's question (its positions), not data, and go to every
    task.  A text's windows are compared as hashes of whole code-point arrays; only those that
    are asked for become strings, and a task sends its partial counts.
    """
    wanted = sorted({r["ctx"] for r in asked.select("ctx").distinct().collect() if r["ctx"] is not None})
    base = 0x9E3779B97F4A7C15

    def hashes(codes):
        h = np.zeros(max(len(codes) - k + 1, 0), np.uint64)
        for j in range(k):
            h = h * np.uint64(base) + codes[j:j + len(h)].astype(np.uint64) + np.uint64(1)
        return h

    def run(batches):
        import pyarrow as pa
        table = np.sort(np.array([hashes(np.frombuffer(c.encode("utf-32-le"), np.uint32))[0] for c in wanted if len(c) == k], np.uint64))
        known, n, chars = set(wanted), {}, set()
        for b in batches:
            for text in b.column("text").to_pylist():
                if not text:
                    continue
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                chars.update(np.unique(codes).tolist())
                if len(table) and len(codes) > k:
                    h = hashes(codes)[:-1]
                    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                    for i in np.flatnonzero(table[at] == h).tolist():
                        ctx = text[i:i + k]
                        if ctx in known:
                            n[ctx, text[i + k]] = n.get((ctx, text[i + k]), 0) + 1
        rows = [(c, x, v) for (c, x), v in n.items()] + [(None, chr(c), 0) for c in chars]
        cols = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["ctx", "next", "n"])
    found = cut_lineage(texts.select("text").mapInArrow(run, "ctx string, next string, n long"))
    counts = found.where("ctx is not null").groupBy("ctx", "next").agg(F.sum("n").alias("n"))
    return counts, found.where("ctx is null").select("next").distinct().count()


# P17 / J7 ------------------------------------------------------------------------
def changed_windows(pairs: DataFrame, k: int, key: str = "doc_id", old: str = "old", new: str = "new") -> DataFrame:
    """(key, pos, old_ctx, old_next, new_ctx, new_next) of the windows that differ between two
    versions of a text held in one row; past the end of the shorter one its side is null.

    Only windows that hold a differing character are built; no join is needed.
    """
    field = pairs.schema[key]

    def run(batches):
        import pyarrow as pa
        names = ("row", "pos", "old_ctx", "old_next", "new_ctx", "new_next")

        def made(b, cols):
            keys = b.column(key).take(pa.array(cols["row"], pa.int64()))
            return pa.RecordBatch.from_arrays([keys, pa.array(cols["pos"], pa.int32())] + [pa.array(cols[c], pa.string()) for c in names[2:]], names=[key, *names[1:]])
        for b in batches:
            cols = {c: [] for c in names}
            for row, (o, n) in enumerate(zip(b.column("__o").to_pylist(), b.column("__n").to_pylist())):
                o, n = o or "", n or ""
                if o == n:
                    continue
                a, c = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (o, n))
                short, most = min(len(a), len(c)), max(len(a), len(c))
                differs = np.ones(most, bool)              # past the shorter text's end as well
                np.not_equal(a[:short], c[:short], out=differs[:short])
                hit = np.zeros(max(most - k, 0), bool)
                for j in range(k + 1 if len(hit) else 0):
                    hit |= differs[j:j + len(hit)]
                at = np.flatnonzero(hit).tolist()
                cols["row"] += [row] * len(at)
                cols["pos"] += at
                for t, side in ((o, "old"), (n, "new")):
                    there = [p + k < len(t) for p in at]
                    cols[f"{side}_ctx"] += [t[p:p + k] if ok else None for p, ok in zip(at, there)]
                    cols[f"{side}_next"] += [t[p + k] if ok else None for p, ok in zip(at, there)]
                if len(cols["pos"]) > BATCH_ROWS:
                    yield made(b, cols)
                    cols = {c: [] for c in names}
            yield made(b, cols)
    d = pairs.select(key, F.col(old).alias("__o"), F.col(new).alias("__n"))
    return d.mapInArrow(run, f"`{key}` {field.dataType.simpleString()}, pos int, old_ctx string, old_next string, new_ctx string, new_next string")


def unlearn_counts(counts: DataFrame, changed: DataFrame) -> DataFrame:
    """Counts after the change: minus the old windows, plus the new ones, nothing else."""
    side = lambda s, n: changed.where(F.col(f"{s}_ctx").isNotNull()).select(F.col(f"{s}_ctx").alias("ctx"), F.col(f"{s}_next").alias("next"), F.lit(n).cast("bigint").alias("n"))
    return (counts.unionByName(side("old", -1)).unionByName(side("new", 1)).groupBy("ctx", "next").agg(F.sum("n").alias("n")).where("n > 0"))


def model(counts: DataFrame, V: int, alpha: float) -> DataFrame:
    """(ctx, next, n, tot, p) with additive smoothing."""
    tot = counts.groupBy("ctx").agg(F.sum("n").alias("tot"))
    return counts.join(tot, "ctx").withColumn(
        "p", (F.col("n") + F.lit(alpha)) / (F.col("tot") + F.lit(alpha * V)))


def score_positions(pos: DataFrame, counts: DataFrame, V: int, alpha: float) -> DataFrame:
    """Adds p for rows (..., ctx, ch): seen pair, seen context only, or unseen context."""
    tot = counts.groupBy("ctx").agg(F.sum("n").alias("tot"))
    pair = counts.select("ctx", F.col("next").alias("ch"), "n")
    j = pos.join(pair, ["ctx", "ch"], "left").join(tot, "ctx", "left")
    p = F.when(F.col("tot").isNull(), F.lit(1.0 / V)).otherwise(
        (F.coalesce(F.col("n"), F.lit(0)) + F.lit(alpha)) / (F.col("tot") + F.lit(alpha * V)))
    return j.withColumn("p", p)


def sequence_positions(spark: SparkSession, start: str, seq: str, k: int, seq_id: int = 0) -> DataFrame:
    """(seq_id, i, ctx, ch) for predicting seq after start with an order-k model."""
    full = start + seq
    rows = [(seq_id, i, full[len(start) + i - k: len(start) + i], seq[i]) for i in range(len(seq))]
    return spark.createDataFrame(rows, "seq_id int, i int, ctx string, ch string")


# X1 / W5 ------------------------------------------------------------------------
def sequence_perplexity(spark, counts: DataFrame, start: str, seq: str, k: int, V: int,
                        alpha: float) -> DataFrame:
    """(i, ch, p, running): -log2 p per position and the running sum (log-perplexity)."""
    pos = score_positions(sequence_positions(spark, start, seq, k), counts, V, alpha)
    w = Window.partitionBy("seq_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pos.withColumn("running", F.sum(-F.log2("p")).over(w)).select("i", "ch", "p", "running")


# X2 -----------------------------------------------------------------------------
def random_sequences(spark: SparkSession, n: int, length: int, alphabet: list[str], start: str, k: int,
                     seed) -> DataFrame:
    """(sample, i, ctx, ch) for n seeded random strings over ``alphabet`` after ``start``."""
    al = F.array(*[F.lit(c) for c in alphabet])
    s = spark.range(n).select(F.col("id").alias("sample"))
    chars = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.element_at(
        al, (F.pmod(phash(F.concat_ws(":", F.col("sample").cast("string"), i.cast("string")), seed),
                    F.lit(len(alphabet))) + 1).cast("int")))
    s = s.withColumn("full", F.concat(F.lit(start), F.array_join(chars, "")))
    pos = s.select("sample", "full", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i"))
    L = len(start)
    return pos.select("sample", F.col("i").cast("int").alias("i"),
                      F.substring("full", F.col("i") + L - k + 1, k).alias("ctx"),
                      F.substring("full", F.col("i") + L + 1, 1).alias("ch"))


def perplexity_distribution(spark, counts: DataFrame, n: int, length: int, alphabet: list[str], start: str,
                            k: int, V: int, alpha: float, seed) -> DataFrame:
    """(sample, pp): log-perplexity of every random sequence."""
    pos = score_positions(random_sequences(spark, n, length, alphabet, start, k, seed), counts, V, alpha)
    return pos.groupBy("sample").agg(F.sum(-F.log2("p")).alias("pp"))


# X3 / X4 --------------------------------------------------------------------------
def space_size_log2(alphabet_size: int, length: int) -> float:
    return length * math.log2(alphabet_size)


def empirical_exposure(dist: DataFrame, value: float) -> DataFrame:
    """(rank, n, exposure): -log2(share of sampled sequences at least as likely).

    Rank 0 (none as likely) leaves the exposure open: it is null, not log2(n)."""
    return dist.agg(F.sum(F.when(F.col("pp") <= F.lit(value), 1).otherwise(0)).alias("rank"),
                    F.count(F.lit(1)).alias("n")).withColumn("exposure", F.when(F.col("rank") > 0, -F.log2(F.col("rank") / F.col("n"))))


# Nodes of the quadratures below: Gauss-Legendre on [0, 1], and a panel count for Simpson's rule.
GAUSS_NODES, SIMPSON_PANELS, TAIL = 40, 4000, 10.0


def gauss_legendre(n: int = GAUSS_NODES) -> list[tuple[float, float]]:
    x, w = np.polynomial.legendre.leggauss(n)
    return [((a + 1) / 2, b / 2) for a, b in zip(x.tolist(), w.tolist())]


def normal_cdf(x) -> Column:
    """Phi(x) = 1/2 + x * integral over u in [0, 1] of phi(x u), cut at |x| = 8."""
    x = F.greatest(F.least(x, F.lit(8.0)), F.lit(-8.0))
    nodes = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(w).alias("w")) for u, w in gauss_legendre()])
    return F.lit(0.5) + x * F.aggregate(nodes, F.lit(0.0), lambda acc, e: acc + e["w"] * F.exp(-x * x * e["u"] * e["u"] / 2)) / F.lit(math.sqrt(2 * math.pi))


def skewnorm_fit(dist: DataFrame, value: str = "pp") -> DataFrame:
    """(xi, omega, alpha) of the skew-normal with the mean, deviation and skewness of the values, in
    one aggregate; |skewness| is clamped below 0.995.  Without spread alpha and omega are 0."""
    m = dist.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.skewness(value).alias("g"))
    m = m.withColumn("g", F.greatest(F.least(F.coalesce("g", F.lit(0.0)), F.lit(0.995)), F.lit(-0.995)))
    m = m.withColumn("a", F.pow(2 * F.abs("g") / (4 - math.pi), F.lit(1 / 3)))
    m = m.withColumn("delta", F.signum("g") * F.sqrt(F.lit(math.pi / 2) * F.col("a") * F.col("a") / (1 + F.col("a") * F.col("a"))))
    omega = F.col("s") / F.sqrt(1 - 2 * F.col("delta") * F.col("delta") / math.pi)
    return m.select((F.col("m") - omega * F.col("delta") * math.sqrt(2 / math.pi)).alias("xi"), omega.alias("omega"),
                    (F.col("delta") / F.sqrt(1 - F.col("delta") * F.col("delta"))).alias("alpha"))


def skewnorm_exposure(dist: DataFrame, values: DataFrame, value: str = "pp") -> DataFrame:
    """The rows of ``values`` (a few, each with ``value``) with ``cdf`` and ``exposure`` = -log2 cdf under the
    skew-normal fitted to ``dist``.

    cdf = integral of 2 phi(t) Phi(alpha t) up to z = (value - xi) / omega by Simpson's rule over the
    last ``TAIL`` units, all panels as rows.  Exposure is null where the tail is too small for
    a double, and the cdf a step where ``dist`` has no spread.
    """
    fit = skewnorm_fit(dist, value)
    v = values.crossJoin(F.broadcast(fit)).withColumn("z", (F.col(value) - F.col("xi")) / F.nullif("omega", F.lit(0.0)))
    t = F.col("z") - F.lit(TAIL) + F.lit(TAIL / SIMPSON_PANELS) * F.col("i")
    weight = F.when(F.col("i").isin(0, SIMPSON_PANELS), 1.0).when(F.col("i") % 2 == 1, 4.0).otherwise(2.0) * F.lit(TAIL / SIMPSON_PANELS / 3)
    density = F.lit(2 / math.sqrt(2 * math.pi)) * F.exp(-t * t / 2) * normal_cdf(F.col("alpha") * t)
    panels = v.select("*", F.explode(F.sequence(F.lit(0), F.lit(SIMPSON_PANELS))).alias("i"))
    cdf = F.when(F.first("omega") > 0, F.least(F.sum(weight * density), F.lit(1.0))).otherwise((F.first(value) >= F.first("xi")).cast("double"))
    out = panels.groupBy(*values.columns).agg(cdf.alias("cdf"))
    return out.withColumn("exposure", F.when(F.col("cdf") > 0, -F.log2("cdf")))


# T5 / X5 ------------------------------------------------------------------------
def top_next(counts: DataFrame, top_k: int) -> DataFrame:
    """(ctx, rank, next): the k most likely next characters per context (ties by character).

    The window runs over the aggregated table: at most |alphabet| rows per context."""
    w = Window.partitionBy("ctx").orderBy(F.desc("n"), F.asc("next"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k) \
        .select("ctx", F.col("rank").cast("int").alias("rank"), "next")


def greedy_continue(starts: DataFrame, counts: DataFrame, k: int, steps: int, min_char: str) -> DataFrame:
    """Appends ``steps`` argmax characters to every ``start`` (unseen context -> smallest char)."""
    best = cut_lineage(top_next(counts, 1).select("ctx", F.col("next").alias("__nx")))      # every step reads it
    out = starts.withColumn("gen", F.lit(""))
    for _ in range(steps):
        cur = F.concat(F.col("start"), F.col("gen"))
        out = out.withColumn("ctx", F.substring(cur, -k, k)).join(best, "ctx", "left") \
            .withColumn("gen", F.concat(F.col("gen"), F.coalesce(F.col("__nx"), F.lit(min_char)))) \
            .drop("__nx", "ctx")
    return out


# X6 -----------------------------------------------------------------------------
def sampled_continue(starts: DataFrame, counts: DataFrame, k: int, steps: int, top_k: int, seed, min_char: str,
                     key: str = "sid", weighted: bool = False) -> DataFrame:
    """Appends ``steps`` drawn characters to every ``start``: each from the ``top_k`` most likely ones, the
    first step without the very likeliest (T5).

    The cumulated table of a context is an array of at most top_k + 1 entries, so a step is one
    join and an inverse-CDF look-up: the first entry whose running weight passes u times the
    total, weight 1 each or (``weighted``) its count.  u is a hash of (key, step).  A context
    without candidates gives the smallest character.
    """
    first = F.array_sort(F.collect_list(F.struct("rank", "next", "n")))
    best = cut_lineage(top_next(counts, top_k + 1).join(counts, ["ctx", "next"]).groupBy("ctx").agg(first.alias("cand")))      # every step reads it
    out = starts.withColumn("gen", F.lit(""))
    for step in range(steps):
        allowed = F.filter("cand", lambda e: e["rank"].between(2, top_k + 1) if step == 0 else e["rank"] <= top_k)
        weight = (lambda e: e["n"].cast("double")) if weighted else (lambda e: F.lit(1.0))
        out = out.withColumn("ctx", F.substring(F.concat("start", "gen"), -k, k)).join(best, "ctx", "left").withColumn("cand", allowed)
        total = F.aggregate("cand", F.lit(0.0), lambda acc, e: acc + weight(e))
        u = uniform(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(step))), seed)
        out = out.withColumn("goal", u * total)
        pick = F.aggregate("cand", F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("string").alias("c")),
                           lambda acc, e: F.struct((acc["run"] + weight(e)).alias("run"),
                                                   F.when(acc["c"].isNull() & (acc["run"] + weight(e) > F.col("goal")), e["next"]).otherwise(acc["c"]).alias("c")))
        out = out.withColumn("gen", F.concat("gen", F.coalesce(pick["c"], F.lit(min_char)))).drop("cand", "ctx", "goal")
    return out


# X7 -----------------------------------------------------------------------------
def canary_digits(spark: SparkSession, counts: DataFrame, start: str, secret: str, reference: str, k: int, V: int, alpha: float) -> DataFrame:
    """(i, p_secret, p_reference, running): per character of the secret its probability, that of the
    replacement character after the same prefix, and the log-perplexity so far."""
    pos = sequence_positions(spark, start, secret, k)
    own = score_positions(pos, counts, V, alpha).select("seq_id", "i", F.col("p").alias("p_secret"))
    other = score_positions(pos.withColumn("ch", F.lit(reference)), counts, V, alpha).select("i", F.col("p").alias("p_reference"))
    w = Window.partitionBy("seq_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.join(other, "i").withColumn("running", F.sum(-F.log2("p_secret")).over(w)).drop("seq_id")


def count_model_fit(counts: DataFrame, V: int, alpha: float) -> DataFrame:
    """(windows, loss, accuracy): mean -ln p and share of windows whose next character is the likeliest
    of its context, over all windows, from the counts alone."""
    w = Window.partitionBy("ctx").orderBy(F.desc("n"), F.asc("next"))
    m = model(counts, V, alpha).withColumn("top", F.row_number().over(w) == 1)
    total = F.sum("n")
    return m.agg(total.alias("windows"), (F.sum(-F.col("n") * F.log("p")) / total).alias("loss"),
                 (F.sum(F.when(F.col("top"), F.col("n")).otherwise(0)) / total).alias("accuracy"))
