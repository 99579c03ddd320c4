"""Sums of packed numeric blocks: one block a task and key, merged in two levels.

A task sends its partial sums as one packed array a key instead of one row a number.  The
arrays meet in at most ``STREAMS`` tasks first (by the sender's number), then by key, so
neither a merging task nor the driver sees more than one block a key and stream.  Within a
stream blocks are added in the order of their tasks: a rerun gives the same bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STREAMS = 32
_SCHEMA = "task int, key int, body binary"


def _batch(task: int, blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "task": pa.array([task] * len(blocks), pa.int32()), "key": pa.array(list(blocks), pa.int32()),
        "body": pa.array([np.ascontiguousarray(v, dtype="<f8").tobytes() for v in blocks.values()], pa.binary())})


def _add(batches: Iterable[pa.RecordBatch]):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for key, body in zip(b.column("key").to_pylist(), b.column("body").to_pylist()):
            part = np.frombuffer(body, "<f8")
            total[key] = total[key] + part if key in total else part
    if total:
        yield _batch(TaskContext.get().partitionId(), total)


# Packed rows: a loop reads the same rows many times, and list columns are costly to send to Python.
# Rows of few columns, nearly all of them set, may be packed with a list ``x`` of fixed size in
# place of idx and val; a zero in it is a column that the row does not have.
PACK, PACK_ROWS, PACK_BYTES = "pack", 1 << 16, 1 << 24


def is_packed(rows: DataFrame) -> bool:
    return rows.columns == [PACK]


def to_packs(batches: Iterable[pa.RecordBatch]):
    """The batches as rows of one column ``pack``: some PACK_ROWS rows as a compressed Arrow stream."""
    def packs(held):
        whole, sink = pa.Table.from_batches(held).combine_chunks(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(whole)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[PACK])
    held, n, size = [], 0, 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n, size = n + b.num_rows, size + b.nbytes
        if n >= PACK_ROWS or size >= PACK_BYTES:
            yield packs(held)
            held, n, size = [], 0, 0
    if held:
        yield packs(held)


def unpacked(batches: Iterable[pa.RecordBatch]):
    """The rows of packs; other batches as they are."""
    for b in batches:
        if b.schema.names != [PACK]:
            yield b
            continue
        for body in b.column(0):
            with pa.ipc.open_stream(body.as_buffer()) as rows:
                yield from rows


def packed(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns as packs; a packed table as it is."""
    return rows if is_packed(rows) else rows.select(*columns).mapInArrow(to_packs, f"{PACK} binary")


def map_packs(rows: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """The packs of the batches that ``each`` makes of a packed table's batches."""
    return rows.mapInArrow(lambda batches: to_packs(map(each, unpacked(batches))), f"{PACK} binary")


def matrix(x: pa.FixedSizeListArray) -> np.ndarray:
    """The rows of a list column of fixed size without nulls, as a matrix."""
    return x.flatten().to_numpy().reshape(len(x), -1)


def fixed_lists(x: np.ndarray) -> pa.FixedSizeListArray:
    """The rows of a matrix as such a list column."""
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x, dtype=float).ravel()), x.shape[1])


def columns_of(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns that a step reads; a packed table brings all of its own."""
    return rows if is_packed(rows) else rows.select(*columns)


def block_table(rows: DataFrame, partial: Callable[[Iterable[pa.RecordBatch]], dict[int, np.ndarray]]) -> DataFrame:
    """(key, body): for every key the sum over all tasks of the blocks that ``partial`` gives
    for the task's batches; body holds little-endian doubles.  ``rows`` may be packed."""
    def run(batches):
        blocks = partial(unpacked(batches))
        if blocks:
            yield _batch(TaskContext.get().partitionId(), blocks)
    parts = rows.mapInArrow(run, _SCHEMA)
    streams = min(STREAMS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = parts.repartition(streams, F.pmod("task", F.lit(streams))).sortWithinPartitions("task", "key").mapInArrow(_add, _SCHEMA)
    return some.repartition("key").sortWithinPartitions("key", "task").mapInArrow(_add, _SCHEMA).select("key", "body")


def block_sums(rows: DataFrame, partial) -> dict[int, np.ndarray]:
    """The table of ``block_table`` on the driver: one block a key."""
    return {r["key"]: np.frombuffer(r["body"], "<f8") for r in block_table(rows, partial).collect()}


DENSE = 64                     # widest rows that are multiplied as dense ones
CELLS = 1 << 16                # most numbers of an array that a step makes of dense rows, to stay near a core's cache


class Rows:
    """Sparse rows (y, idx, val) of an Arrow batch."""

    def __init__(self, batch: pa.RecordBatch):
        import pyarrow.compute as pc
        self.n = batch.num_rows
        self.sizes = pc.list_value_length(batch.column("idx")).fill_null(0).to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(self.n), self.sizes)
        self.col = pc.list_flatten(batch.column("idx")).to_numpy(zero_copy_only=False).astype(np.int64)
        self.val = pc.list_flatten(batch.column("val")).to_numpy(zero_copy_only=False).astype(float)

    def where(self, mask: np.ndarray) -> Rows:
        """The rows of a mask."""
        out = object.__new__(Rows)
        entry = mask[self.row]
        out.n, out.sizes = int(mask.sum()), self.sizes[mask]
        out.row, out.col, out.val = (np.cumsum(mask) - 1)[self.row[entry]], self.col[entry], self.val[entry]
        return out

    def dot(self, a: np.ndarray, val: np.ndarray | None = None) -> np.ndarray:
        """X a for a of (d, m)."""
        out = np.zeros((self.n, a.shape[1]))
        full = np.flatnonzero(self.sizes)
        if len(full):
            first = np.concatenate([[0], np.cumsum(self.sizes[full])[:-1]])
            out[full] = np.add.reduceat((self.val if val is None else val)[:, None] * a[self.col], first, axis=0)
        return out

    def tdot(self, f: np.ndarray, d: int) -> np.ndarray:
        """X' f for f of (n, m)."""
        out = np.zeros((d, f.shape[1]))
        if len(self.col):
            order = np.argsort(self.col, kind="stable")
            col = self.col[order]
            first = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
            out[col[first]] = np.add.reduceat(self.val[order, None] * f[self.row[order]], first, axis=0)
        return out

    def has(self, columns: np.ndarray) -> np.ndarray:
        """Whether a row has one of the columns, for columns of (d, m) as 0 or 1."""
        return self.dot(columns, np.abs(self.val)) > 0

    def dense(self, d: int, val: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.row * d + self.col, self.val if val is None else val, self.n * d).reshape(self.n, d)

    def small(self, d: int) -> Rows | Dense:
        """The rows as a matrix where d is small."""
        return Dense(self.dense(d), self.dense(d, np.abs(self.val))) if d <= DENSE else self


class Dense:
    """Rows as a matrix, with the same products; ``size`` holds sums of absolute values where they are
    not those of the matrix."""

    def __init__(self, x: np.ndarray, size: np.ndarray | None = None):
        self.n, self.x, self.size = len(x), x, size

    def where(self, mask: np.ndarray) -> Dense:
        return Dense(self.x[mask], None if self.size is None else self.size[mask])

    def small(self, d: int) -> Dense:
        return self

    def dot(self, a: np.ndarray) -> np.ndarray:
        return self.x @ a

    def tdot(self, f: np.ndarray, d: int) -> np.ndarray:
        return self.x.T @ f

    def has(self, columns: np.ndarray) -> np.ndarray:
        return (np.abs(self.x) if self.size is None else self.size) @ columns > 0

    def dense(self, d: int) -> np.ndarray:
        return self.x


def row_chunks(batches: Iterable[pa.RecordBatch], width: int, limit: int = 1 << 21, dense: int | None = None):
    """(batch slice, Rows) in steps whose entries times ``width`` stay near ``limit``; (batch slice, Dense)
    of dense packs in steps whose rows times ``dense`` (or ``width``) stay near CELLS."""
    for whole in unpacked(batches):
        if not whole.num_rows:
            continue
        if "x" in whole.schema.names:
            x = matrix(whole.column("x"))
            step = max(1024, CELLS // (dense or max(x.shape[1], width)))
            for at in range(0, whole.num_rows, step):
                yield whole.slice(at, step), Dense(x[at:at + step])
            continue
        entries = max(1, len(whole.column("idx").flatten()) // whole.num_rows)
        step = max(1, limit // (entries * max(1, width)))
        for at in range(0, whole.num_rows, step):
            part = whole.slice(at, step)
            yield part, Rows(part)
