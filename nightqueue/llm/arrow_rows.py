"""Helpers for mapInArrow bodies: bounded output batches and extra columns carried along."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Characters of text that one output batch is made from, about.
BATCH_CHARS = 4_000_000


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose strings sum to about `limit` bytes; every run has a row."""
    sizes = batch.column(column).nbytes
    if sizes <= limit or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The strings of a column, null as the empty string."""
    return [x or "" for x in batch.column(column).to_pylist()]
