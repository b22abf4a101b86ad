"""Arrow string columns as flat bytes, so that whole batches are handled by numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and len + 1 offsets into them, the first of which is 0."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, "i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "i8")
    data = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(column: pa.Array) -> pa.Array:
    """The column with A-Z lower-cased."""
    data, offsets = flat(column)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data])])
