"""Rows of an Arrow list column as matrices."""

from __future__ import annotations


def by_dimension(column, scaled: bool = False):
    """Yields (row indexes, float64 matrix) for each dimension: rows that are not null, not empty and hold finite numbers only."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.list_(pa.float64()))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components: NaN
    sizes = np.diff(offsets)
    finite = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = valid & (sizes > 0) & (finite[offsets[1:]] == finite[offsets[:-1]])
    for d in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == d))
        yield rows, values[offsets[rows][:, None] + np.arange(d)]
