"""Vectors of an Arrow list column as numpy matrices, one for each length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of a matrix, so a task's memory does not follow the batch.
ROWS = 4096


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and components (double) of the usable rows, in matrices of one length and of ROWS rows at most.

    A row is usable if it is neither null nor empty and has finite entries only, none of them null.
    """
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)  # null entries come as NaN
    sizes = np.diff(offsets)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[valid]).tolist():
        places = np.flatnonzero(valid & (sizes == size)) if size else np.zeros(0, np.int64)
        for k in range(0, len(places), ROWS):
            some = places[k : k + ROWS]
            matrix = values[offsets[some][:, None] + np.arange(size)]
            usable = np.isfinite(matrix).all(axis=1)
            if usable.any():
                yield some[usable], matrix[usable]


def floored(matrix: np.ndarray, factor: float, most: float) -> np.ndarray:
    """``floor(factor * x)`` as whole numbers, held between -most and most."""
    return np.clip(np.floor(matrix * factor), -most, most).astype(np.int64)
