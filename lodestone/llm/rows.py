"""Shared helpers of the operators: Arrow batch plumbing and in-row expressions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Sum of the elements before each one (array<bigint>), in blocks so that long arrays stay near-linear."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def within(part: Column, base: Column) -> Column:
        return F.transform(part, lambda _, i: base + total(F.slice(part, 1, i)))

    def run(a: Column) -> Column:
        count = F.ceil(F.size(a) / F.lit(block)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(a, b * block + 1, block))
        return let(
            blocks,
            lambda parts: let(
                F.transform(parts, total),
                lambda sums: F.flatten(F.transform(parts, lambda part, b: let(total(F.slice(sums, 1, b)), lambda base: within(part, base)))),
            ),
        )

    return F.when(F.size(lengths) > 0, let(lengths, run)).otherwise(F.array().cast("array<bigint>"))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def task_base(bits: int = 40) -> int:
    """The first of 2**bits row numbers that belong to this task alone."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << bits


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each batch with the number of its first row, unique over all tasks and the same when a task runs again."""
    at = task_base()
    for batch in batches:
        yield at, batch
        at += batch.num_rows


#: Rows, and bytes of text unless one row has more, that an operator turns into Python objects at once.
ROWS, BYTES = 512, 2_000_000

_owner: list[str | None] = [None]
_memos: dict[str, list[Callable[[], None]]] = {}


def memo(owner: str, clear: Callable[[], None]) -> None:
    """Tells how to clear what `owner`'s operator remembers in a worker between tasks."""
    _memos.setdefault(owner, []).append(clear)


def trim() -> None:
    """Hands freed memory back to the system, where the platform can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(owner: str, batches: Iterator[pa.RecordBatch], place: int, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches of one task of `owner`'s operator, cut by rows and by the bytes of the text column at `place`.

    Python workers outlive operators: what another operator remembers in this one goes first, and freed memory is
    handed back when the task is over, so that a worker holds one operator's tables at a time.
    """
    if _owner[0] != owner:
        _owner[0] = owner
        for clear in (c for other, clears in _memos.items() if other != owner for c in clears):
            clear()
        trim()
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            upto = min(max(upto, at + 1), at + rows)
            yield batch.slice(at, upto - at)
            at = upto
    trim()
