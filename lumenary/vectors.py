"""Arrow list columns as NumPy matrices, with the rule that says which vectors are usable."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable_rows(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix float32) of the lists that hold exactly `dim` finite values that are not all zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = np.asarray(lists.offsets)
    lengths = np.diff(offsets)
    ok = lengths == dim
    if lists.null_count:
        ok &= np.asarray(lists.is_valid())
    at = np.flatnonzero(ok)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    values = lists.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # null elements become NaN
    starts = offsets[at]
    if len(at) == len(lists) and starts[-1] - starts[0] == dim * (len(at) - 1):
        m = flat[starts[0] : starts[0] + dim * len(at)].reshape(len(at), dim)
    else:
        m = flat[starts[:, None] + np.arange(dim)]
    good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return at[good], np.ascontiguousarray(m[good])


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length in double precision (scaled by the largest component first, so that tiny or huge rows keep their direction)."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def fixed_binary(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    m = np.ascontiguousarray(m)
    width = m.shape[1] * m.itemsize
    offsets = np.arange(len(m) + 1, dtype=np.int64) * width
    if len(m) * width < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(m.tobytes())])
    return pa.array([r.tobytes() for r in m], pa.binary())


def from_binary(col: pa.Array | pa.ChunkedArray, dtype: str, dim: int) -> np.ndarray:
    """The inverse of fixed_binary."""
    if isinstance(col, pa.ChunkedArray):
        parts = [from_binary(c, dtype, dim) for c in col.chunks if len(c)]
        return np.concatenate(parts) if parts else np.empty((0, dim), dtype)
    if not len(col):
        return np.empty((0, dim), dtype)
    offsets = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(col), dim)
