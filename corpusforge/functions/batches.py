"""Arrow columns worked on in parts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa


def by_slices(function: Callable[..., pa.Array], *columns: pa.Array, rows: int = 512) -> pa.Array:
    """``function`` of equal slices of the columns, put together again.

    What is made of the rows stays as small as that of a slice, however many a batch has.
    """
    size = max(1, len(columns[0]))
    whole = pa.concat_arrays([function(*(c.slice(at, rows) for c in columns)) for at in range(0, size, rows)])
    pa.default_memory_pool().release_unused()  # a worker lives on after its task
    return whole
