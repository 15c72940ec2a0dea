"""Passes over Arrow batches: streaming the runs of equal keys of a sorted partition, and workers that keep no freed memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return what this process has freed to the system; the allocators of Arrow and C keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def lean(make: Pass) -> Pass:
    """``make`` with freed memory given back after each batch that it reads, and at its end.

    Spark keeps idle workers, so what a pass leaves in them stands beside the steps after it,
    also beside those that run without Python.
    """

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    @wraps(make)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(fed(batches))
        give_back()

    return run


def by_run(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """One table per run of rows with equal, non-null values in the columns ``names``.

    Only one run is held at a time, so callers bound the length of runs, not of partitions.
    Empty batches and partitions give nothing; columns with nulls must not be among ``names``.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        columns = [table.column(c).to_numpy() for c in names]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *change.tolist(), len(table)] if len(table) else []
        for a, b in zip(edges, edges[1:]):
            name = tuple(c[a] for c in columns)
            if held and name != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = name
    if held:
        yield pa.concat_tables(held)
