"""List columns of vectors as integer matrices, inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

EXACT_FLOAT = 1 << 53  # integer sums below this are exact in doubles
EXACT_LONG = 1 << 63
LARGEST = 1 << 27  # largest absolute integer component: squared distances of 64 components still fit a long


def finite_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, components): the places of rows that are a list of finite numbers, their lengths and their components one after the other."""
    rows = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    held = col.take(pa.array(rows))
    flat = held.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    size = np.diff(held.offsets.to_numpy())
    owner = np.repeat(np.arange(len(rows)), size)
    good = np.ones(len(rows), bool)
    good[owner[~np.isfinite(values)]] = False
    return rows[good], size[good], values[good[owner]]


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as 64-bit integers; a component beyond LARGEST has no exact place in the sums and stops the job."""
    x = np.floor(values * scale)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale} in size")
    return x.astype(np.int64)


def batched(fn: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 4096):
    """``fn`` over slices of a task's batches."""
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, rows):
                yield fn(b.slice(a, rows))
    return run


def product(x: np.ndarray, y: np.ndarray, bound: int) -> np.ndarray:
    """Exact ``x @ y`` of integers whose sums stay below ``bound``: by doubles where these are exact, else by longs."""
    if bound < EXACT_FLOAT:
        return (x.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    if bound >= EXACT_LONG:
        raise OverflowError("integer product beyond a long")
    return x @ y
