"""Groups of rows that stand together in sorted partitions, for ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in the first ``keys`` columns (numbers without nulls); holds one run and one batch."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changed = np.any([v[1:] != v[:-1] for v in values], axis=0)
        starts = [0, *(np.nonzero(changed)[0] + 1).tolist()]
        for start, end in zip(starts, [*starts[1:], n], strict=True):
            key = tuple(v[start] for v in values)
            if held and key != last:
                yield _one(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
