"""Distances between all rows of two matrices, by name, for work in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lumenary.functions.distances import CHI2_EPSILON

#: Numbers of a block of differences that is held at once.
HELD = 1 << 22
MatrixDistance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _blocks(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> MatrixDistance:
    """f over (x[:, None], y[None]) in blocks of rows."""

    def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        step = max(1, HELD // max(1, y.size))
        parts = [f(x[i : i + step, None, :], y[None]) for i in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.empty((0, len(y)))

    return distance


def _divergence(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = np.broadcast_arrays(x, y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (np.where(x > 0, x * np.log(2 * x / (x + y)), 0) + np.where(y > 0, y * np.log(2 * y / (x + y)), 0)).sum(axis=2)


MATRIX: dict[str, MatrixDistance] = {
    "l1norm": _blocks(lambda x, y: np.abs(x - y).sum(axis=2)),
    "l2norm_squared": _blocks(lambda x, y: ((x - y) ** 2).sum(axis=2)),
    "l2norm": _blocks(lambda x, y: np.sqrt(((x - y) ** 2).sum(axis=2))),
    "one_minus_dot": lambda x, y: 1 - x @ y.T,
    "jsd": _blocks(_divergence),
    "chi2": _blocks(lambda x, y: ((x - y) ** 2 / (x + y + CHI2_EPSILON)).sum(axis=2)),
}


def matrix_distance(name: str | MatrixDistance) -> MatrixDistance:
    """The distance of that name; an unknown name is an error."""
    if callable(name):
        return name
    if name not in MATRIX:
        raise ValueError(f"unknown distance {name!r}; known: {', '.join(sorted(MATRIX))}")
    return MATRIX[name]
