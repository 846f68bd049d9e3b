"""Arrow batches cut by bytes, so that a Python worker's memory has a bound whatever the rows hold."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows and text bytes that a slice holds at most; a single longer row is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20


def sizes(column: pa.Array) -> list[int]:
    """Bytes of each value of a string or binary array, nulls as zero."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], by: str, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut so that column ``by`` stays under ``most`` bytes a slice."""
    for batch in batches:
        start = held = 0
        for k, n in enumerate(sizes(batch.column(by))):
            if k > start and (held + n > most or k - start >= rows):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Returns a worker's free memory to the system: workers outlive their tasks, and another job's may need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
