"""Feature preparation (E1-E10, A3, A4, A6, A7, W3, W4) as DataFrame transforms.

Statistics that parameterise a transform (min/max, mean/std, modes, category
lists) are aggregated by Spark and are parameter-sized: one value per (split,
column) or per distinct category.  They reach the driver and come back as
literals, so the transform itself is a narrow projection with no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rand import phash
from .prefix import global_rank

# Default token rule of the bag-of-words vectoriser (two or more
# letters, digits or underscores) and the default paragraph break of the canary
# inserter (two newlines and two spaces before a word character, insertion 4
# characters after the start of the break).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
CANARY_BREAK = "\n\n  \\w"
CANARY_BREAK_OFFSET = 4


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _let(value: Column, body) -> Column:
    """body(value), the value computed once a row however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _case_by(by: str | None, groups: dict, make) -> Column:
    """Build ``CASE by WHEN g THEN make(stats_g) ... END`` from collected per-group stats."""
    if by is None:
        return make(groups[None])
    expr = None
    for g, st in groups.items():
        e = make(st)
        expr = F.when(F.col(by) == F.lit(g), e) if expr is None else expr.when(F.col(by) == F.lit(g), e)
    return expr


# A4 -----------------------------------------------------------------------------
def column_stats(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """min, max, mean and population std per column (and per group)."""
    stacked = df.select(*( [by] if by else []),
                        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                     F.col(c).cast("double").alias("v")) for c in cols])).alias("e"))
    keys = ([by] if by else []) + [F.col("e.feature").alias("feature")]
    return (stacked.groupBy(*keys)
            .agg(F.min("e.v").alias("min"), F.max("e.v").alias("max"),
                 F.avg("e.v").alias("mean"), F.stddev_pop("e.v").alias("std")))


def _collect_stats(df: DataFrame, cols: Sequence[str], by: str | None, moments: bool = True) -> dict:
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
        if moments:
            aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    rows = (df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)).collect()
    out = {}
    for r in rows:
        d = r.asDict()
        out[d.get(by) if by else None] = {
            c: (d[f"{c}__min"], d[f"{c}__max"], d.get(f"{c}__mean"), d.get(f"{c}__std")) for c in cols}
    return out


# E4 -----------------------------------------------------------------------------
def minmax_scale(df: DataFrame, cols: Sequence[str], by: str | None = "split") -> DataFrame:
    """Per-column min-max scaling, fitted separately per ``by`` group; constant column -> 0."""
    stats = _collect_stats(df, cols, by, moments=False)
    out = df
    for c in cols:
        def make(st, c=c):
            mn, mx, _, _ = st[c]
            rng = (mx - mn) if (mx is not None and mn is not None and mx != mn) else 1.0
            return (F.col(c).cast("double") - F.lit(float(mn or 0.0))) / F.lit(float(rng))
        out = out.withColumn(c, _case_by(by, stats, make))
    return out


# E5 -----------------------------------------------------------------------------
def standardize(df: DataFrame, cols: Sequence[str], by: str | None = "split") -> DataFrame:
    """(x - mean) / population std per group; zero variance -> x - mean."""
    stats = _collect_stats(df, cols, by)
    out = df
    for c in cols:
        def make(st, c=c):
            _, _, mean, std = st[c]
            s = std if std else 1.0
            return (F.col(c).cast("double") - F.lit(float(mean or 0.0))) / F.lit(float(s))
        out = out.withColumn(c, _case_by(by, stats, make))
    return out


def l2_normalize_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row-wise L2 normalisation over a set of numeric columns (sklearn Normalizer)."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
    out = df.withColumn("__n", norm)
    for c in cols:
        out = out.withColumn(c, F.when(F.col("__n") > 0, F.col(c) / F.col("__n")).otherwise(F.col(c)))
    return out.drop("__n")


# A3 -----------------------------------------------------------------------------
def _value_counts(df: DataFrame, cols: Sequence[str], by: str | None) -> DataFrame:
    """(by, column, value, n) of all columns in one aggregate."""
    keys = [by] if by else []
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("e"))
    return (stacked.where(F.col("e.value").isNotNull())
            .groupBy(*keys, F.col("e.column").alias("column"), F.col("e.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def value_frequencies(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """(column, value, n, rank): frequency list per column, rank 1 = most frequent, ties by value.

    One distributed rank over all columns, less what stands before each column: no task has
    all distinct values of a column.
    """
    keys = [by] if by else []
    ranked = global_rank(_value_counts(df, cols, by), [*map(F.col, keys), F.col("column"), F.desc("n"), F.asc("value")], "__r")
    before = ranked.groupBy(*keys, "column").agg((F.min("__r") - 1).alias("__before"))
    out = ranked.join(F.broadcast(before), [*keys, "column"])        # a row a column and group
    return out.select(*keys, "column", "value", "n", (F.col("__r") - F.col("__before")).cast("int").alias("rank"))


# E6 -----------------------------------------------------------------------------
def impute_mode(df: DataFrame, cols: Sequence[str], by: str | None = "split",
                strategy: str = "most_frequent") -> DataFrame:
    """Fill nulls with the per-group most frequent value, or the constant '0'."""
    if strategy != "most_frequent":
        return df.fillna({c: "0" for c in cols})
    keys = [by] if by else []
    top = _value_counts(df, cols, by).groupBy(*keys, "column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    modes = {(r[by] if by else None, r["column"]): r["value"] for r in top.collect()}
    out = df
    for c in cols:
        groups = {g: None for (g, cc) in modes if cc == c}
        if not groups:
            continue
        fill = _case_by(by, {g: g for g in groups}, lambda g, c=c: F.lit(modes[(g, c)])) if by else F.lit(modes[(None, c)])
        out = out.withColumn(c, F.coalesce(F.col(c), fill))
    return out


# E7 / E8 --------------------------------------------------------------------------
def category_vocab(train: DataFrame, cols: Sequence[str], offset: int, drop_first: bool = True) -> tuple[DataFrame, int]:
    """(dim, feature, category, value) of one-hot columns, ordered by column then frequency,
    and the number of dims.  Only one count per column reaches the driver."""
    first = 2 if drop_first else 1
    freq = value_frequencies(train, cols).where(F.col("rank") >= first)
    sizes = {r["column"]: r["count"] for r in freq.groupBy("column").count().collect()}
    base, start = offset, None
    for c in cols:
        here = F.when(F.col("column") == c, F.lit(base))
        start = here if start is None else F.coalesce(start, here)
        base += sizes.get(c, 0)
    vocab = freq.select((start + F.col("rank") - first).cast("int").alias("dim"), F.concat_ws("_", "column", "value").alias("feature"),
                        F.col("column").alias("category"), "value")
    return vocab, base - offset


def one_hot_dims(df: DataFrame, vocab: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Adds the array of one-hot dims set in each row (unseen values have none): one join a column."""
    for c in cols:
        dims = vocab.where(F.col("category") == c).select(F.col("value").alias(f"__v_{c}"), F.col("dim").alias(f"__d_{c}"))
        df = df.join(dims, F.col(c).cast("string") == F.col(f"__v_{c}"), "left").drop(f"__v_{c}")
    dims = F.filter(F.array(*[F.col(f"__d_{c}") for c in cols]), lambda x: x.isNotNull())
    return df.withColumn(name, dims).drop(*[f"__d_{c}" for c in cols])


# E1 / A6 ---------------------------------------------------------------------------
def tokenize(text) -> Column:
    """Lower-cased word tokens: runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def document_frequency(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, df): number of documents containing the token (partial aggregation, skew-safe)."""
    return (docs.select(F.explode(F.array_distinct(F.col(tokens))).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("df")))


def build_vocab(train_docs: DataFrame, min_df: int, tokens: str = "tokens") -> DataFrame:
    """(dim, feature): tokens with document frequency >= min_df, dims in alphabetical order
    (a distributed rank, so the vocabulary never meets in one task)."""
    kept = document_frequency(train_docs, tokens).where(F.col("df") >= min_df).select("token")
    return global_rank(kept, [F.col("token")], "__r").select((F.col("__r") - 1).cast("int").alias("dim"), F.col("token").alias("feature"))


# E1 / E3 --------------------------------------------------------------------------
def binary_bag_of_words(docs: DataFrame, vocab: DataFrame, key: str = "row_id", tokens: str = "tokens") -> DataFrame:
    """Sparse ``idx``/``val`` (binary presence, L2-normalised rows) instead of the token column.

    (doc, token) pairs meet the vocabulary in a join that AQE broadcasts once it has measured
    it, or splits where a token is frequent.  A row with n tokens has n entries of 1/sqrt(n).
    """
    carried = [c for c in docs.columns if c not in (key, tokens)]
    pairs = docs.select(key, *carried, F.explode_outer(F.array_distinct(F.col(tokens))).alias("feature"))
    # the row's other columns ride along, so the rows are not joined to their own aggregate
    out = pairs.join(vocab.select("feature", "dim"), "feature", "left").groupBy(key, *carried).agg(F.array_sort(F.collect_list("dim")).alias("idx"))
    return out.withColumn("val", F.array_repeat(F.lit(1.0) / F.sqrt(F.greatest(F.size("idx"), F.lit(1)).cast("double")), F.size("idx")))


# E2 -----------------------------------------------------------------------------
def line_tokens(text) -> Column:
    """Every non-empty line is one token, case kept."""
    return F.filter(F.split(_c(text), "\n"), lambda s: F.length(s) > 0)


def line_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, n) occurrence counts of line tokens per document."""
    return (docs.select(key, F.explode(line_tokens(text)).alias("token"))
            .groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")))


# A7 -----------------------------------------------------------------------------
def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return (docs.select(F.explode(tokenize(text)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


# W3 -----------------------------------------------------------------------------
def feature_set_copies(samples: DataFrame, key: str = "row_id", idx: str = "idx") -> DataFrame:
    """(key, n_copies): the first row (smallest key) of every distinct feature set.

    Grouped by the set and its hash; the partial aggregate keeps a set that a third of all
    rows have from landing in one task.
    """
    return (samples.groupBy(F.xxhash64(idx).alias("__h"), F.col(idx).alias("__set"))
            .agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_copies")).select(key, "n_copies"))


# W4 -----------------------------------------------------------------------------
def char_windows(docs: DataFrame, key: str, length: int, text: str = "text", packed: bool = False) -> DataFrame:
    """Overlapping stride-1 windows: (key, pos, ctx, next) for every position of every text; ``packed``
    leaves the windows of a text in one row (key, text), for a step that keeps some of them.

    The text is split into a character array once per row, and every window is a
    slice of that array, so the cost is linear in the text length (a substring
    per position would rescan the UTF-8 bytes from the start each time).
    """
    if packed:
        return docs.select(key, _c(text).alias("text"))
    chars = F.split(_c(text), "")
    n = F.size("__chars")
    positions = F.when(n > length, F.sequence(F.lit(0), n - length - 1)).otherwise(F.array().cast("array<int>"))
    return (docs.select(key, chars.alias("__chars"))
            .select(key, "__chars", F.explode(positions).alias("pos"))
            .select(key, F.col("pos").cast("int").alias("pos"),
                    F.array_join(F.slice("__chars", F.col("pos") + 1, length), "").alias("ctx"),
                    F.element_at("__chars", F.col("pos") + length + 1).alias("next")))


# E9 -----------------------------------------------------------------------------
def char_vocab(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, ch): sorted distinct characters, code = 0-based rank."""
    def run(batches):
        seen = np.zeros(0x110000, bool)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen[np.frombuffer(t.encode("utf-32-le"), np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in np.flatnonzero(seen).tolist()], pa.string())], names=["ch"])
    chars = docs.select(F.col(text)).mapInArrow(run, "ch string").distinct()
    return chars.select((F.row_number().over(Window.orderBy("ch")) - 1).cast("int").alias("code"), "ch")


def _with_array(docs: DataFrame, source: str, name: str, kind: T.DataType, make) -> DataFrame:
    """Adds (or replaces) ``name``: make(Arrow array of ``source``), a batch of rows at a time."""
    names = docs.columns if name in docs.columns else [*docs.columns, name]
    kept = [c for c in names if c != name]
    schema = T.StructType([T.StructField(name, kind) if c == name else docs.schema[c] for c in names])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([make(b.column("__from")) if c == name else b.column(c) for c in names], names=names)
    return docs.select(*kept, F.col(source).alias("__from")).mapInArrow(run, schema)


# F11 ----------------------------------------------------------------------------
def encode_text(docs: DataFrame, vocab: DataFrame, text: str = "text", name: str = "codes") -> DataFrame:
    """Adds the character codes of a text by a supplied vocabulary (code, ch), null for a character
    that it lacks; null text stays null.  The vocabulary is alphabet-sized and sent as one table."""
    entries = [(ord(r["ch"]), r["code"]) for r in vocab.select("ch", "code").collect() if r["ch"] and len(r["ch"]) == 1 and r["code"] is not None]

    def encode(t: pa.Array) -> pa.Array:
        code, known = np.zeros(0x110000, np.int32), np.zeros(0x110000, bool)
        if entries:
            at, value = zip(*entries)
            code[list(at)], known[list(at)] = value, True
        points = [np.frombuffer((s or "").encode("utf-32-le"), np.uint32) for s in t.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in points])]).astype(np.int32)
        every = np.concatenate([*points, np.empty(0, np.uint32)])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[every], mask=~known[every]), mask=t.is_null())
    return _with_array(docs, text, name, T.ArrayType(T.IntegerType()), encode)


def decode_text(docs: DataFrame, vocab: DataFrame, codes: str = "codes", name: str = "text", unknown: str = "\ufffd") -> DataFrame:
    """The text of character codes; a code that is null or not in the vocabulary is ``unknown``."""
    entries = sorted((r["code"], r["ch"]) for r in vocab.select("code", "ch").collect() if r["code"] is not None and r["ch"] is not None)

    def decode(c: pa.Array) -> pa.Array:
        import pyarrow.compute as pc
        known, letters = np.array([e[0] for e in entries], np.int64), np.array([*(e[1] for e in entries), unknown], object)
        flat = pc.list_flatten(c)
        value = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(known, value)
        found = (known[np.minimum(at, len(known) - 1)] == value if len(known) else np.zeros(len(value), bool)) & flat.is_valid().to_numpy(zero_copy_only=False)
        at = np.where(found, at, len(known))
        ends = np.cumsum(pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        return pa.array([None if gone else "".join(letters[at[a:b]].tolist()) for a, b, gone in zip([0, *ends], ends, c.is_null().to_pylist())], pa.string())
    return _with_array(docs, codes, name, T.StringType(), decode)


# E10 ----------------------------------------------------------------------------
def insert_canary(docs: DataFrame, key: str, canary: str, n: int, seed: int = 42,
                  pattern: str = CANARY_BREAK, offset: int = CANARY_BREAK_OFFSET,
                  text: str = "text") -> DataFrame:
    """Insert ``canary`` at ``n`` randomly chosen breaks of each text.

    A break is a match of ``pattern``; the canary goes ``offset`` characters after
    the start of the match.  The choice is a seeded hash rank over the break ordinals
    of each text (at most the number of breaks present).
    """
    # text = piece 0, then (match, piece) pairs; matches do not overlap.  What the rebuilding reads at
    # every break is bound once a row (_let): as columns the optimizer may move it into the lambda
    def chosen(m):
        ranked = F.transform(F.sequence(F.lit(1), F.greatest(F.size(m), F.lit(1))),
                             lambda i: F.struct(phash(F.concat(F.col(key).cast("string"), F.lit(":"),
                                                               i.cast("string")), seed).alias("h"), i.alias("i")))
        return F.when(F.size(m) > 0, F.transform(F.slice(F.array_sort(ranked), 1, n), lambda s: s["i"])) \
            .otherwise(F.array().cast("array<int>"))

    def tail(s, m, i):
        part = F.concat(m, F.get(s["p"], i + 1))
        return F.when(F.array_contains(s["c"], i + 1), F.concat(F.substring(part, 1, offset), F.lit(canary),
                                                               F.substring(part, F.lit(offset + 1), F.length(part)))).otherwise(part)

    def rebuilt(s):
        whole = F.concat(F.get(s["p"], F.lit(0)), F.array_join(F.transform(s["m"], lambda m, i: tail(s, m, i)), ""))
        return F.struct(whole.alias("text"), F.size(s["c"]).alias("n"))
    broken = _let(F.regexp_extract_all(F.col(text), F.lit(pattern), 0),
                  lambda m: F.struct(F.split(F.col(text), pattern).alias("p"), m.alias("m"), chosen(m).alias("c")))
    out = docs.withColumn("__t", _let(broken, rebuilt))
    return out.withColumn(text, F.col("__t.text")).withColumn("n_inserted", F.col("__t.n")).drop("__t")
