"""Samplers of points in an image, by name: functions of (width, height, number) that give whole-pixel points [n, 2]."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, sqrt

import numpy as np

Sampler = Callable[[int, int, int], np.ndarray]
SAMPLERS: dict[str, tuple[Sampler, int]] = {}


def register(name: str, number: int) -> Callable[[Sampler], Sampler]:
    """Register a sampler with its default number of points."""

    def keep(f: Sampler) -> Sampler:
        SAMPLERS[name] = f, number
        return f

    return keep


def sample(name: str, width: int, height: int, number: int | None = None) -> np.ndarray:
    """Points of the sampler of that name; unknown names are errors."""
    if name not in SAMPLERS:
        raise ValueError(f"unknown sampler {name!r}; known: {', '.join(sorted(SAMPLERS))}")
    f, default = SAMPLERS[name]
    return f(width, height, default if number is None else number)


@register("grid", 625)
def grid(width: int, height: int, number: int) -> np.ndarray:
    """ceil(sqrt(number))^2 points on a grid inside the image, x-major."""
    side = ceil(sqrt(number))
    x, y = (np.floor(np.arange(1, side + 1) * (size / (side + 1))).astype(int) for size in (width, height))
    return np.stack([np.repeat(x, side), np.tile(y, side)], axis=1)


@register("random_area", 500)
def random_area(width: int, height: int, number: int) -> np.ndarray:
    """Points drawn uniformly from all pixels, with a seed made of the sizes, so that a run can be repeated."""
    rng = np.random.default_rng([width, height, number])
    return np.stack([rng.integers(0, width, number), rng.integers(0, height, number)], axis=1)
