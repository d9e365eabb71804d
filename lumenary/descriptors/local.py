"""Local histograms of directional responses around sampled points, as both sketch descriptors use them."""

from __future__ import annotations

from math import sqrt

import numpy as np


def _mirrored(n: int, before: int, after: int) -> np.ndarray:
    """Places -before .. n + after - 1, mirrored at the borders without repeating the edge."""
    at = np.abs(np.arange(-before, n + after))
    last = max(1, n - 1)
    return last - np.abs(last - at % (2 * last)) if n > 1 else np.zeros_like(at)


def blur(m: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The image convolved with a symmetric kernel of odd size along both axes."""
    half = len(kernel) // 2
    for _ in range(2):
        padded, n = m[_mirrored(len(m), half, half)], len(m)
        m = sum(w * padded[i : i + n] for i, w in enumerate(kernel)).T
    return m


def box_sum(m: np.ndarray, size: int) -> np.ndarray:
    """Sums over windows of size x size pixels whose place size // 2 lies on the pixel."""
    for _ in range(2):
        padded = m[_mirrored(len(m), size // 2, size - 1 - size // 2)]
        sums = np.vstack([np.zeros((1, m.shape[1])), np.cumsum(padded, axis=0)])
        m = (sums[size:] - sums[:-size]).T
    return m


def gaussian(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-x * x / (2 * sigma * sigma))
    return k / k.sum()


def normalised(features: np.ndarray, how: str) -> np.ndarray:
    """Rows by l2 (plus the spacing of float32 at 1), by their sum (lowe), or as they are (none)."""
    if how == "l2":
        return features / (np.sqrt((features**2).sum(axis=1, keepdims=True)) + np.finfo(np.float32).eps)
    if how == "lowe":
        total = np.abs(features).sum(axis=1, keepdims=True)
        return np.divide(features, total, out=np.zeros_like(features), where=total > 0)
    if how == "none":
        return features
    raise ValueError(f"unknown normalisation {how!r}; known: l2, lowe, none")


def local_histograms(responses: np.ndarray, grey: np.ndarray, points: np.ndarray, tiles: int, share: float, smooth: bool, normalise: str = "l2", canvas: tuple[int, int] | None = None) -> dict:
    """features, positions and numfeatures of responses [orientation, y, x] to a grey image (255: no stroke).

    A patch has `share` of the image's area, in tiles x tiles tiles of whole pixels; responses are summed over a tile (Gaussian
    or box) in a frame of one tile, and read at the tiles' centers around each point. Patches without a stroke have no feature.
    canvas (height, width): the white area in which a patch may lie, the image at its origin.
    """
    height, width = grey.shape
    tile = max(1, -(-int(sqrt(width * height * share)) // tiles))
    size = tile * tiles
    framed = np.pad(responses, ((0, 0), (tile, tile), (tile, tile)))
    framed = np.stack([blur(r, gaussian(2 * tile + 1, tile / 3)) if smooth else box_sum(r, tile) for r in framed])

    corner = points - size // 2
    high, wide = canvas or (height, width)
    ink = np.zeros((high + 1, wide + 1))
    ink[1 : height + 1, 1 : width + 1] = 255 - grey
    ink = np.cumsum(np.cumsum(ink, axis=0), axis=1)
    limit = np.array([wide, high])
    (x0, y0), (x1, y1) = np.clip(corner, 0, limit).T, np.clip(corner + size, 0, limit).T
    drawn = ink[y1, x1] - ink[y0, x1] - ink[y1, x0] + ink[y0, x0] > 0
    points, corner = points[drawn], corner[drawn]

    centers = np.floor(corner[:, :, None] + tile + tile / 2 + tile * np.arange(tiles)).astype(int)
    x, y = centers[:, 0][:, None, :], centers[:, 1][:, :, None]
    inside = (x >= 0) & (y >= 0) & (x < framed.shape[2]) & (y < framed.shape[1])
    read = framed[:, np.clip(y, 0, framed.shape[1] - 1), np.clip(x, 0, framed.shape[2] - 1)] * inside
    features = normalised(np.moveaxis(read, 0, -1).reshape(len(points), tiles * tiles * len(responses)), normalise)
    positions = points / np.array([width, height])
    return {"features": features.astype(np.float32).tolist(), "positions": positions.astype(np.float32).tolist(), "numfeatures": len(points)}
