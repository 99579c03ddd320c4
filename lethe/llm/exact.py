"""Exact dedup by distributed MSD radix partitioning.

Texts are compared after deleting ASCII white space, byte by byte from the front; no
digest takes part in equality.

1. Each task radix-splits its chunk of documents in memory and passes on one
   representative per distinct text, so a text that a third of all rows have reaches the
   shuffle once per chunk.
2. Representatives are split by their first bytes.  A prefix whose texts weigh more than a
   leaf may is split again by more bytes (8, 32, 128, ...), until the group is small or its
   texts have ended.  Only the heavy prefixes are kept, at most 2**20 of a width.
3. Each leaf is radix-split to the end of its texts in one task, as a stream: a text equal
   to one seen before is dropped at once, so memory is bounded by the leaf.
4. Rows get the verdict of their representative by a join on its number.

Defined results: null text is empty, and empty texts are equal to each other; of equal rows
with equal length and id one stays; a null id counts as larger than any other; an empty
table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .words import NULL_ID

_SPACE = b" \t\n\x0b\x0c\r"
_WIDTH, _GROW = 8, 4
_MAX_HEAVY = 1 << 20
_LEAST_LEAF = 1 << 14


def radix_groups(texts: list[bytes]) -> list[list[int]]:
    """Index lists of equal texts: groups are split by successive runs of bytes until they
    have one member or their texts have ended."""
    done, open_ = [], [(list(range(len(texts))), 0, _WIDTH)]
    while open_:
        group, at, width = open_.pop()
        parts: dict[bytes, list[int]] = {}
        for i in group:
            parts.setdefault(texts[i][at:at + width], []).append(i)
        for digit, part in parts.items():
            if len(part) == 1 or len(digit) < width:
                done.append(part)
            else:
                open_.append((part, at + width, width * _GROW))
    return done


class RadixTree:
    """Texts by successive runs of bytes; a text that has no neighbour yet is kept whole."""

    def __init__(self):
        self.root: dict = {}

    def put(self, text: bytes) -> list:
        """The entry [text, ...] of this text, new if its length is 1."""
        node, at, width = self.root, 0, _WIDTH
        while True:
            digit = text[at:at + width]
            held = node.get(digit)
            if held is None:
                held = node[digit] = [text]
                return held
            at, width = at + width, width * _GROW
            if isinstance(held, list):
                if held[0] == text:
                    return held
                held = node[digit] = {held[0][at:at + width]: held}
            node = held


def _chunks(batches, limit: int):
    """Slices of the batches that weigh about ``limit`` bytes of text at most (one row at least)."""
    for b in batches:
        ends = pa.compute.binary_length(b.column("__text")).to_numpy().cumsum()
        first = 0
        while first < b.num_rows:
            base = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(ends.searchsorted(base + limit, side="right")))
            yield b.slice(first, last - first)
            first = last


def _collapsed(batches, limit):
    """Per chunk: (first row number, batch, ids, code points, texts, groups of equal texts)."""
    base = TaskContext.get().partitionId() << 32
    for b in _chunks(batches, limit):
        texts = [t.translate(None, _SPACE) for t in b.column("__text").to_pylist()]
        yield base, b, b.column("__id").to_pylist(), b.column("__points").to_pylist(), texts, radix_groups(texts)
        base += len(texts)


def leaf(text: bytes, heavy) -> bytes:
    """The shortest prefix, in the ladder of widths, that is not heavy."""
    width = _WIDTH
    while len(text) >= width and text[:width] in heavy:
        width *= _GROW
    return text[:width]


def _weigh(width, heavy, limit):
    """Bytes of representatives by prefix; only those whose shorter prefix is heavy."""
    def run(batches):
        for _, _, _, _, texts, groups in _collapsed(batches, limit):
            size: dict[bytes, int] = {}
            for g in groups:
                t = texts[g[0]]
                if width == _WIDTH or len(t) >= width // _GROW and t[:width // _GROW] in heavy:
                    size[t[:width]] = size.get(t[:width], 0) + len(t)
            yield pa.RecordBatch.from_pydict({"head": pa.array(list(size), pa.binary()), "size": pa.array(list(size.values()), pa.int64())})
    return run


def _representatives(heavy, limit):
    def run(batches):
        for base, _, ids, points, texts, groups in _collapsed(batches, limit):
            out = {k: [] for k in ("leaf", "rep", "text", "members", "best_points", "best_id", "best_row")}
            for g in groups:
                best = min(g, key=lambda i: (-points[i], ids[i], i))
                for k, v in zip(out, (leaf(texts[best], heavy), base + g[0], texts[best], len(g), points[best], ids[best], base + best)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if k in ("leaf", "text") else pa.int64()) for k, v in out.items()], names=list(out))
    return run


def _members(limit, columns, with_digest):
    """Each row: the given columns, its number, its representative's number, its digest."""
    def run(batches):
        for base, b, ids, _, texts, groups in _collapsed(batches, limit):
            rep, sha = [0] * len(ids), [None] * len(ids)
            for g in groups:
                digest = hashlib.sha256(texts[g[0]]).hexdigest() if with_digest else None
                for i in g:
                    rep[i], sha[i] = base + g[0], digest
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(range(base, base + len(ids)), pa.int64()),
                                              pa.array(rep, pa.int64()), pa.array(sha, pa.string())], names=[*columns, "__row", "__rep", "__sha"])
    return run


def _settle(batches):
    """Rows come sorted by leaf; a leaf's verdicts leave when the next leaf begins."""
    tree, entries, at, held = RadixTree(), [], None, 0

    def verdicts():
        out = [(rep, keep, row, size) for _, size, (_, keep, row), reps in entries for rep in reps]
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rep", "keep_id", "keep_row", "group_size"])
    for b in batches:
        cols = (b.column(k).to_pylist() for k in ("leaf", "rep", "text", "members", "best_points", "best_id", "best_row"))
        for head, rep, text, n, points, i, row in zip(*cols):
            if head != at:
                if held > 8 << 20:
                    yield verdicts()
                    entries, held = [], 0
                tree, at = RadixTree(), head
            e = tree.put(text)
            mine = (-points, i, row)
            if len(e) == 1:
                e += [n, mine, [rep]]
                entries.append(e)
                held += len(text) + 200
            else:
                e[1] += n
                e[2] = min(e[2], mine)
                e[3].append(rep)
    if entries:
        yield verdicts()


def _rows(docs: DataFrame, id_col: str, text_col: str, columns) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"),
                       F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("__points"),
                       F.col(text_col).isNull().alias("__null"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))


def _heavy_prefixes(rows: DataFrame, chunk_bytes: int, leaf_bytes: int) -> frozenset:
    """Prefixes of representatives that weigh more than a leaf: an eighth of a shuffle
    partition's share, or ``leaf_bytes`` if that is less; at most _MAX_HEAVY a width."""
    heavy: frozenset = frozenset()
    width = _WIDTH
    while True:
        sizes = rows.mapInArrow(_weigh(width, heavy, chunk_bytes), "head binary, size long").groupBy("head").agg(F.sum("size").alias("size"))
        if width == _WIDTH:
            total, most = sizes.agg(F.sum("size"), F.max("size")).first()
            share = (total or 0) // (8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            leaf_bytes = max(min(leaf_bytes, max(share, _LEAST_LEAF)), (total or 0) // _MAX_HEAVY)
            if (most or 0) <= leaf_bytes:
                return heavy
        found = sizes.filter((F.col("size") > leaf_bytes) & (F.octet_length("head") == width)).select("head").collect()
        if not found:
            return heavy
        heavy |= {bytes(r[0]) for r in found}
        width *= _GROW


def _resolved(docs, id_col, text_col, columns, extra, with_digest, chunk_bytes, leaf_bytes) -> DataFrame:
    """Each row with its verdict.  Rows are numbered twice, on the way to the leaves and here;
    both read the same columns of ``docs``, so that its plan gives them in the same order."""
    rows = _rows(docs, id_col, text_col, columns)
    heavy = _heavy_prefixes(rows, chunk_bytes, leaf_bytes)
    reps = rows.mapInArrow(_representatives(heavy, chunk_bytes),
                           "leaf binary, rep long, text binary, members long, best_points long, best_id long, best_row long")
    settled = (reps.repartition("leaf").sortWithinPartitions("leaf")
               .mapInArrow(_settle, "rep long, keep_id long, keep_row long, group_size long"))
    carried = [*columns, *extra]
    schema = rows.select(*carried).schema.add("__row", "long").add("__rep", "long").add("__sha", "string")
    members = rows.mapInArrow(_members(chunk_bytes, carried, with_digest), schema)
    return members.join(settled.withColumnsRenamed({c: f"__{c}" for c in settled.columns}), "__rep")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16 << 20,
                leaf_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the text without
    white space; not used for equality).  Of equal texts the row with the most code points
    in the original text, then the smallest id, stays."""
    out = _resolved(docs, id_col, text_col, [id_col], [], True, chunk_bytes, leaf_bytes)
    return out.select(F.col(id_col).cast("long").alias("id"), F.expr(f"nullif(__keep_id, {NULL_ID}L)").alias("keep_id"),
                      F.col("__group_size").alias("group_size"), (F.col("__row") == F.col("__keep_row")).alias("kept"),
                      F.col("__sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16 << 20,
                leaf_bytes: int = 16 << 20) -> DataFrame:
    """The rows that stay, with all their columns."""
    others = [c for c in docs.columns if c != text_col]
    out = _resolved(docs, id_col, text_col, others, ["__null", "__text"], False, chunk_bytes, leaf_bytes)
    text = F.when(~F.col("__null"), F.col("__text").cast("string")).alias(text_col)
    return out.filter("__row = __keep_row").select(*(text if c == text_col else c for c in docs.columns))
