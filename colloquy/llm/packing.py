"""Arrays of integers as binary columns that shuffle and Parquet compression make small."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """Differences of successive integers, byte plane by byte plane: the high planes are nearly all zero."""
    d = np.diff(values.astype(np.int64), prepend=np.int64(0)).astype(f"<i{width}")
    return d.view(np.uint8).reshape(-1, width).T.tobytes()


def unplanes(data: bytes, width: int = 8) -> np.ndarray:
    d = np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(f"<i{width}").ravel()
    return np.cumsum(d.astype(np.int64))


def binaries(column) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` ranges of hashes each one falls into."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
