"""Small pieces of Arrow batches, so that what a Python worker makes of a batch stays small whatever the batch size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS = 500


def small(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task keeps no batches
