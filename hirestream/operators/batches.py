"""Arrow batches in tasks."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Rows that a task has as Python objects at a time (a row may be a long text).
ROWS = 256


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def lists(rows: list, values: pa.Array) -> pa.ListArray:
    """An array of lists as long as those of ``rows``, over the ``values`` of all."""
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def string_lists(rows: list[list[str]]) -> pa.ListArray:
    return lists(rows, pa.array([x for r in rows for x in r], pa.string()))


def list_rows(column: pa.ListArray) -> list[list]:
    """The rows of an array of lists (none null) as Python lists; ``to_pylist`` would make an
    object of Arrow's for each value first."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False).tolist(), column.offsets.to_numpy()
    ends = (ends - ends[0]).tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:])]
