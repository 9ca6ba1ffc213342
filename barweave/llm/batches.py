"""Whole groups out of a stream of Arrow batches that is sorted by group."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def give_back() -> None:
    """Return this process's unused memory to the machine: a Python worker that waits for its next task keeps it else."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def grouped(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[pa.RecordBatch]:
    """A batch for each run of equal values of the integer column ``key``; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and values[a] != last:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)
    held = batch = None
    give_back()


def pieces_of(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most, for work that copies a batch's texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    give_back()
