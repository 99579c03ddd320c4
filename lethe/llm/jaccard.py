"""N-gram Jaccard join by adaptive multi-match prefixes.

Two documents link when their sets of word shingles overlap by ``percent`` of the union or
more.  Any such pair shares, for every l, at least l tokens among the first n - c + l of
either set in one global order, where n is the set's size and c = ceil(percent * n).

1. Screen: in hash order, each document sends its prefix for l = n / 20 through a packed
   look-up (see ``shards``); a document stays only if enough of its prefix is shared.
2. Document frequencies of all tokens of what stays give the global order, rarest first.
   Each document then picks l by cost: postings that its prefix reads, plus the candidates
   this leaves to verify, at most postings / l.  A longer prefix demands more shared tokens.
3. In a few rounds each document is verified against the leader that most of its posting
   lists name; linked components are joined.  A list that lies in one component needs no
   more work, so groups of near copies cost a comparison or two a document.
4. All pairs of different components that share a token of their 1-prefixes are then
   formed, at the places that the two sizes allow; a pair with min(l, l') shared tokens or
   more in its longer prefixes is verified.  No pair is capped or dropped.

Verification compares whole shingle sets.  Copies (equal sets) are collapsed beforehand.

Defined results: null text and text without words have the empty set, linked with nothing;
with fewer than ``k`` words the whole sequence is the one shingle; rows with the same id
(null included) are one document with several texts; an empty table gives an empty result;
columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import shards as S
from .graph import components
from .words import NULL_ID, chunks, mix, roll, split

_KEY = 6                       # bytes of a token that are compared within a bucket
_LOW = np.uint64((1 << 8 * _KEY) - 1)
_SCREEN = 20                   # the screen asks for n / 20 shared tokens
_VERIFY = 16                   # cost of a verification, in postings
_ROUNDS = 3                    # rounds against leaders before all pairs left are counted


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, A-Z folded."""
    out = []
    for _, part in chunks(texts, texts):
        w = split(part, lower=True)
        win = w.windows(k)
        bounds = w.bounds.tolist()
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo >= k:
                h = np.sort(win[lo:hi - k + 1])
                out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
            elif hi > lo:
                out.append(mix(roll(w.hashes[lo:hi], hi - lo) + np.uint64(hi - lo)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def needed(n: int, percent: int) -> int:
    """Tokens that a set of size n shares with any partner."""
    return -(-percent * n // 100)


def _joined(parts) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *parts])


def _screen_prefixes(sets, percent):
    return [s[:len(s) - needed(len(s), percent) + max(1, len(s) // _SCREEN)] for s in sets]


def _send_screen(k, percent, buckets):
    def run(key, table):
        _, texts = S.shard_of(table)
        u = np.unique(_joined(_screen_prefixes(shingle_sets(texts, k), percent)))
        return S.to_buckets(key[0].as_py(), u, buckets, lambda lo, hi: S.low_bytes(u[lo:hi], _KEY))
    return run


def _shared(key, table):
    """To each shard, its tokens that another shard has too."""
    shard, payload = table.column("shard").to_numpy(), table.column("payload").to_pylist()
    sizes = np.array([len(p) // _KEY for p in payload])
    h = S.from_low_bytes(b"".join(payload), _KEY, int(sizes.sum()))
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(first, len(s)))
    mine = np.sort(order[np.repeat(size > 1, size)])
    cut = np.searchsorted(mine, np.concatenate([[0], np.cumsum(sizes)]))
    used = np.flatnonzero(np.diff(cut))
    return S.answers(shard[used].astype(np.int32), [S.low_bytes(h[mine[cut[i]:cut[i + 1]]], _KEY) for i in used.tolist()])


def _apply_screen(k, percent):
    def run(key, left, right):
        ids, texts = S.shard_of(left)
        sets = shingle_sets(texts, k)
        prefixes = _screen_prefixes(sets, percent)
        raw = b"".join(right.column("payload").to_pylist())
        hits = S.from_low_bytes(raw, _KEY, len(raw) // _KEY)
        every = _joined(prefixes)
        u, index, count = np.unique(every, return_inverse=True, return_counts=True)
        found = (np.isin(u & _LOW, hits) | (count > 1))[index]
        at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes], dtype=np.int64)])
        total = np.concatenate([[0], np.cumsum(found)])
        got = total[at[1:]] - total[at[:-1]]
        first: dict[bytes, int] = {}
        rep, cls, blob, size = [], [], [], []
        for d, s in enumerate(sets):
            n = len(s)
            if n and got[d] >= max(1, needed(n, percent) // _SCREEN):
                name = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                new = name not in first
                rep.append(first.setdefault(name, int(ids[d])))
                cls.append(name if new else None)
                blob.append(pa.compress(texts[d], codec="zstd", asbytes=True) if new else None)
                size.append(len(texts[d]) if new else None)
            else:
                for x in (cls, blob, size):
                    x.append(None)
                rep.append(int(ids[d]))
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "rep": pa.array(rep, pa.int64()),
                         "cls": pa.array(cls, pa.binary()), "blob": pa.array(blob, pa.binary()), "size": pa.array(size, pa.int64())})
    return run


def _classes(table):
    """Distinct sets of a shard: smallest id and text of each, and all (id, that id)."""
    best: dict[bytes, list] = {}
    rows = list(zip(*(table.column(c).to_pylist() for c in ("id", "cls", "blob", "size"))))
    for i, c, blob, size in rows:
        if c not in best or i < best[c][0]:
            best[c] = [i, blob, size]
    texts = [pa.decompress(b, z, codec="zstd", asbytes=True) for _, b, z in best.values()]
    return [b[0] for b in best.values()], texts, [(i, best[c][0]) for i, c, _, _ in rows if i != best[c][0]]


def _send_counts(k, buckets):
    def run(key, table):
        _, texts, _ = _classes(table)
        u, count = np.unique(_joined(shingle_sets(texts, k)), return_counts=True)
        count = np.minimum(count, (1 << 16) - 1).astype("<u2")
        return S.to_buckets(key[0].as_py(), u, buckets, lambda lo, hi: S.low_bytes(u[lo:hi], _KEY) + count[lo:hi].tobytes())
    return run


def _frequency(key, table):
    """To each shard, its tokens that two documents have, with their document frequency."""
    shard, payload = table.column("shard").to_numpy(), table.column("payload").to_pylist()
    sizes = np.array([len(p) // (_KEY + 2) for p in payload])
    h = _joined([S.from_low_bytes(p, _KEY, n) for p, n in zip(payload, sizes)])
    count = np.concatenate([np.frombuffer(p, "<u2", n, _KEY * n) for p, n in zip(payload, sizes)]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    df = np.empty(len(h), np.int64)
    df[order] = np.add.reduceat(count[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    mine = np.flatnonzero(df > 1)
    cut = np.searchsorted(mine, np.concatenate([[0], np.cumsum(sizes)]))
    used = np.flatnonzero(np.diff(cut))
    out = [S.low_bytes(h[mine[cut[i]:cut[i + 1]]], _KEY) + np.minimum(df[mine[cut[i]:cut[i + 1]]], (1 << 32) - 1).astype("<u4").tobytes()
           for i in used.tolist()]
    return S.answers(shard[used].astype(np.int32), out)


def choose_prefix(tokens: np.ndarray, df: np.ndarray, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(l, tokens of the l-prefix that another document has, their places in the order) of
    least estimated cost."""
    n = len(tokens)
    c = needed(n, percent)
    order = np.lexsort((tokens, df))
    read = np.cumsum(df[order] - 1)
    l = 1 << np.arange(c.bit_length())
    cost = read[n - c + l - 1] * (1 + _VERIFY / l)
    best = int(l[np.argmin(cost)])
    place = np.flatnonzero(df[order[:n - c + best]] > 1)
    return best, tokens[order[place]], place


def _prefixes(k, percent):
    def run(key, left, right):
        ids, texts, edges = _classes(left)
        parts = [(S.from_low_bytes(p, _KEY, len(p) // (_KEY + 4)), np.frombuffer(p, "<u4", len(p) // (_KEY + 4), _KEY * (len(p) // (_KEY + 4))))
                 for p in right.column("payload").to_pylist()]
        known = _joined([p[0] for p in parts])
        freq = np.concatenate([np.empty(0, "<u4"), *[p[1] for p in parts]]).astype(np.int64)
        order = np.argsort(known)
        known, freq = known[order], freq[order]
        out = [(i, r, 0, 0, 0, None, None) for i, r in edges]
        for i, s in zip(ids, shingle_sets(texts, k)):
            df = np.ones(len(s), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s & _LOW), len(known) - 1)
                df = np.where(known[at] == s & _LOW, freq[at], 1)
            l, prefix, place = choose_prefix(s, df, percent)
            out.append((i, i, len(s), l, int(np.count_nonzero(df > 1)), prefix.view(np.int64), place))
        cols = list(zip(*out)) or [[]] * 7
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "rep", "n", "l", "e", "prefix", "place"])
    return run


def _verify(k, percent):
    """Of the candidate pairs in (x, y, cx, cy, texts), the links (a, b, ca, cb)."""
    def run(batches):
        held = (None, None)
        for b in batches:
            xs = shingle_sets([pa.decompress(t, z, codec="zstd", asbytes=True) for t, z in
                               zip(b.column("x_blob").to_pylist(), b.column("x_size").to_pylist())], k)
            keep = []
            for s, t, z in zip(xs, b.column("y_blob").to_pylist(), b.column("y_size").to_pylist()):
                if held[0] != t:
                    held = (t, shingle_sets([pa.decompress(t, z, codec="zstd", asbytes=True)], k)[0])
                both = np.concatenate([s, held[1]])
                both.sort()
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * inter >= percent * (len(both) - inter))
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=["a", "b", "ca", "cb"]).filter(pa.array(keep, pa.bool_()))
    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough, checkpointed."""
    side = lambda c: texts.select(F.col("id").alias(c), F.col("blob").alias(f"{c}_blob"), F.col("size").alias(f"{c}_size"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    return cut_lineage(both.select("x", "y", "cx", "cy", "x_blob", "x_size", "y_blob", "y_size").mapInArrow(
        _verify(k, percent), "a long, b long, ca long, cb long"))


def _open_lists(posts: DataFrame, r: int) -> DataFrame:
    """Postings of the lists that span several components, with a leader of the list (the
    smallest id at first, then one by a hash that changes with the round)."""
    order = F.xxhash64("id", F.lit(r)) if r else F.lit(0)
    lists = posts.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                       F.min(F.struct(order.alias("h"), "id", "comp", "n", "e", "place")).alias("lead")).filter("low <> high")
    return cut_lineage(posts.join(lists.select("token", "lead"), "token"))


def _possible(x: str, y: str, percent: int):
    """A pair needs t = percent * (n1 + n2) / (100 + percent) shared tokens.  Either side must have
    as many that any other document has (e), and the pair's first shared token stands at place
    n - t or before in either order."""
    col = lambda side, c: F.col(side.format(c))
    t = F.ceil(percent * (col(x, "n") + col(y, "n")) / (100 + percent))
    return ((F.least(col(x, "e"), col(y, "e")) >= t) & (col(x, "place") <= col(x, "n") - t) & (col(y, "place") <= col(y, "n") - t))


def _hooked(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Postings with each component renamed to the smallest one it is linked to.

    One hop a round: equal names always mean connected documents, different ones may too.
    """
    hook = (links.filter("ca <> cb").groupBy(F.greatest("ca", "cb").alias("comp")).agg(F.min(F.least("ca", "cb")).alias("to")))
    return posts.join(hook, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")


def _prepared(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, shard_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, texts, found): all documents with their set's size; the texts of what the screen keeps,
    copies of a shard collapsed; prefixes and the (id, rep) of all copies."""
    n = S.plan_shards(docs, text_col, shard_bytes)
    buckets = n // 2
    packed = S.packed_docs(docs, id_col, text_col, n)
    shared = packed.groupBy("shard").applyInArrow(_send_screen(k, percent, buckets), S.PACKED).groupBy("bucket").applyInArrow(_shared, S.ANSWER)
    table = cut_lineage(packed.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(
        _apply_screen(k, percent), "id long, n long, rep long, cls binary, blob binary, size long"))

    left = table.filter("cls is not null")
    again = S.plan_shards(left, "blob", shard_bytes // 4)
    dealt = left.select("id", "cls", "blob", "size", F.pmod(F.xxhash64("cls"), F.lit(again)).cast("int").alias("shard"))
    freq = dealt.groupBy("shard").applyInArrow(_send_counts(k, again // 2), S.PACKED).groupBy("bucket").applyInArrow(_frequency, S.ANSWER)
    found = cut_lineage(dealt.groupBy("shard").cogroup(freq.groupBy("shard")).applyInArrow(
        _prefixes(k, percent), "id long, rep long, n int, l int, e int, prefix array<long>, place array<int>"))
    return table, left.select("id", "blob", "size"), found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                       shard_bytes: int = S.SHARD_BYTES, rounds: int = _ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links)."""
    table, texts, found = _prepared(docs, id_col, text_col, k, percent, shard_bytes)
    all_links = [table.filter("rep != id").select(F.col("id").alias("a"), F.col("rep").alias("b")),
                 found.filter("rep != id").select(F.col("id").alias("a"), F.col("rep").alias("b"))]
    # postings of the 1-prefixes; the longer ones are compared pair by pair
    posts = (found.filter("prefix is not null").select(F.explode(F.arrays_zip("prefix", "place")).alias("p"), "id", "n", "e", F.col("id").alias("comp"))
             .select(F.col("p.prefix").alias("token"), F.col("p.place").alias("place"), "id", "n", "e", "comp")
             .filter(f"place <= n - ({percent} * n + 99) div 100"))
    for r in range(rounds):
        posts = _open_lists(posts, r)
        star = (posts.filter("comp <> lead.comp").filter(_possible("{}", "lead.{}", percent))
                .groupBy(F.col("id").alias("x"), F.col("lead.id").alias("y"))
                .agg(F.count("*").alias("m"), F.min("comp").alias("cx"), F.min("lead.comp").alias("cy"))
                .groupBy("x").agg(F.max(F.struct("m", (-F.col("y")).alias("neg"), "cx", "cy")).alias("top"))
                .select("x", (-F.col("top.neg")).alias("y"), "top.cx", "top.cy"))
        links = _links(star, texts, k, percent)
        all_links.append(links.select("a", "b"))
        posts = _hooked(posts.drop("lead"), links)
    posts = _open_lists(posts, 0)
    a, b = (posts.select("token", *(F.col(c).alias(c + s) for c in ("id", "n", "e", "place", "comp"))) for s in ("1", "2"))
    near = (a.join(b, "token").filter(F.expr("id1 < id2 and comp1 <> comp2") & _possible("{}1", "{}2", percent))
            .groupBy(F.col("id1").alias("x"), F.col("id2").alias("y")).agg(F.min("comp1").alias("cx"), F.min("comp2").alias("cy")))
    side = lambda c: found.filter("prefix is not null").select(F.col("id").alias(c), F.col("l").alias(f"{c}_l"), F.col("prefix").alias(f"{c}_p"))
    near = (near.join(side("x"), "x").join(side("y"), "y").filter("size(array_intersect(x_p, y_p)) >= least(x_l, y_l)")
            .select("x", "y", "cx", "cy"))
    all_links.append(_links(near, texts, k, percent).select("a", "b"))
    edges = all_links[0]
    for e in all_links[1:]:
        edges = edges.union(e)
    comp = components(edges)
    return (table.select("id", F.col("n").alias("n_shingles")).join(comp, "id", "left")
            .select(F.expr(f"nullif(id, {NULL_ID}L)").alias("id"), "n_shingles",
                    F.expr(f"nullif(coalesce(component, id), {NULL_ID}L)").alias("component_id")))


def _blocks(posts: DataFrame, block: int) -> DataFrame:
    """Postings dealt so that no task joins a whole list: a list of f postings has ceil(f / block) slots
    by hash, and every pair of slots (lo <= hi) is a key of its own."""
    slots = posts.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / block).alias("slots")).filter("slots > 1")
    dealt = posts.join(slots, "token", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("id"), "slots")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    return dealt.select("token", "id", "n", "e", "place", "l", "slot", F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                  shard_bytes: int = S.SHARD_BYTES, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The whole join: (links, members).  Links (a, b) are all pairs a < b of class representatives whose
    sets are similar enough; members (id, class) has every document with its class, the
    smallest id of an equal set.  Ids should be unique.

    Candidates come from the lengthened prefixes: a pair counts its shared tokens there and goes
    to verification with min(l, l') or more.  A group of near copies has as many links as it
    has pairs; ``jaccard_components`` is for those who need its extent only.
    """
    table, texts, found = _prepared(docs, id_col, text_col, k, percent, shard_bytes)
    classes = found.select(F.col("id").alias("rep"), F.col("rep").alias("class"))
    members = table.select("id", "rep").join(classes, "rep", "left").select(
        F.expr(f"nullif(id, {NULL_ID}L)").alias("id"), F.expr(f"nullif(coalesce(class, rep), {NULL_ID}L)").alias("class"))
    posts = found.filter("prefix is not null").select(F.explode(F.arrays_zip("prefix", "place")).alias("p"), "id", "n", "e", "l").select(
        F.col("p.prefix").alias("token"), F.col("p.place").alias("place"), "id", "n", "e", "l")
    dealt = cut_lineage(_blocks(posts, block))
    a, b = (dealt.select("token", "lo", "hi", *(F.col(c).alias(c + s) for c in ("id", "n", "e", "l", "slot"))) for s in ("1", "2"))
    t = F.ceil(percent * (F.col("n1") + F.col("n2")) / (100 + percent))
    pairs = (a.join(b, ["token", "lo", "hi"]).filter("id1 < id2 and (slot1 = lo and slot2 = hi or slot1 = hi and slot2 = lo)")
             .filter(F.least("e1", "e2") >= t).groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("m"), F.min(F.least("l1", "l2")).alias("l"))
             .filter("m >= l").select(F.col("id1").alias("x"), F.col("id2").alias("y"), F.col("id1").alias("cx"), F.col("id2").alias("cy")))
    name = lambda c: F.expr(f"nullif({c}, {NULL_ID}L)").alias(c)
    return _links(pairs, texts, k, percent).select(name("a"), name("b")), members


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, n_links): other documents of the same set and of all linked sets."""
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    ends = links.select(F.col("a").alias("class"), F.col("b").alias("other")).union(links.select("b", "a"))
    linked = ends.join(sizes.select(F.col("class").alias("other"), "size"), "other").groupBy("class").agg(F.sum("size").alias("linked"))
    return members.join(sizes, "class").join(linked, "class", "left").select("id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))


def _row_keys(docs: DataFrame, id_col: str, row: str, key: str) -> DataFrame:
    """Adds ``key``: the id where it is the row's own, else (null or repeated id) a number that no id
    is, made from the row's number.  Ids keep their order, so that leaders stay what they are."""
    ids = docs.select(F.col(id_col).cast("long").alias("_id"))
    low, high, top = ids.agg(F.min("_id"), F.max("_id")).crossJoin(docs.agg(F.max(row))).first()
    if top is None:
        return docs.withColumn(key, F.col(row))
    if high is None or high + 1 + top < NULL_ID:
        fresh = F.lit(0 if high is None else high + 1) + F.col(row)
    elif low - 1 - top > -(1 << 63):
        fresh = F.lit(low - 1) - F.col(row)
    else:                                      # ids over the whole range: the row numbers stand for all
        return docs.withColumn(key, F.col(row))
    many = ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _id is not null")
    joined = docs.join(many, F.col(id_col).cast("long") == F.col("_id"), "left")
    return joined.withColumn(key, F.when(F.col(id_col).isNull() | F.col("_id").isNotNull(), fresh).otherwise(F.col(id_col).cast("long"))).drop("_id", "_n")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                     shard_bytes: int = S.SHARD_BYTES) -> DataFrame:
    """One row of each group of near-duplicates stays, all columns kept: the one with the smallest
    id (null last), of rows with the same id the first in the input.

    Rows are judged, not ids: each gets a number, written once, and a row with a null or repeated
    id joins under a key made from it, as a document of its own.  Rows without words are no
    near copies of anything and stay.
    """
    row, key = "row", "key"
    while {row, key} & set(docs.columns):
        row, key = "_" + row, "_" + key
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    keyed = _row_keys(numbered, id_col, row, key)
    groups = jaccard_components(keyed, key, text_col, k, percent, shard_bytes).select(F.col("id").alias(key), "component_id")
    names = keyed.select(key, row, F.col(id_col).isNull().alias("none"), F.col(id_col).alias("name"))
    first = names.join(groups, key).groupBy("component_id").agg(F.min(F.struct("none", "name", row)).alias("first"))
    return numbered.join(first.select(f"first.{row}"), row, "left_semi").select(*docs.columns)
