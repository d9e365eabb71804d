"""Local histograms of gradient orientations for line drawings (dark strokes on white)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lumenary.descriptors import luminance, register, scaled_to
from lumenary.descriptors.local import blur, gaussian, local_histograms
from lumenary.descriptors.samplers import sample


def gradients(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives (3 x 3) along x and y."""
    p = np.pad(m, 1, mode="reflect" if min(m.shape) > 1 else "edge")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


@register("shog")
@dataclass
class Shog:
    """features (tiles x tiles x num_orients, unit length), positions in [0, 1] and their number; patches without a stroke have none.

    The image is scaled to a longest side of image_width. Gradient magnitudes are split linearly over the three nearest
    of num_orients orientation bins, smoothed over a tile, and read at the tiles' centers around each grid point.
    """

    image_width: int = 256
    num_orients: int = 4
    feature_size: float = 0.125
    tiles: int = 4
    smooth_hist: bool = True
    sampler: str = "grid"
    num_samples: int | None = None

    schema = "features array<array<float>>, positions array<array<float>>, numfeatures int"

    def compute(self, image: np.ndarray) -> dict:
        grey = scaled_to(luminance(image), self.image_width, self.image_width)
        points = sample(self.sampler, grey.shape[1], grey.shape[0], self.num_samples)
        return local_histograms(self._energy(grey), grey, points, self.tiles, self.feature_size, self.smooth_hist)

    def _energy(self, grey: np.ndarray) -> np.ndarray:
        """[orientation, y, x]: gradient magnitude by orientation of the line, in [0, pi)."""
        gx, gy = gradients(np.rint(blur(grey, gaussian(7, 2.0))))
        magnitude = np.hypot(gx, gy)
        with np.errstate(invalid="ignore", divide="ignore"):
            along = np.where(magnitude > 0, np.where(gx < 0, -gy, gy) / magnitude, 0)
        place = np.arccos(np.clip(along, -1, 1)) / np.pi * self.num_orients % self.num_orients
        base = np.minimum(place.astype(int), self.num_orients - 1)
        shift = place - base - 0.5  # from the center of its bin
        out = np.zeros((self.num_orients, *grey.shape))
        y, x = np.indices(grey.shape)
        for step, share in ((0, 1 - np.abs(shift)), (1, np.maximum(shift, 0)), (-1, np.maximum(-shift, 0))):
            np.add.at(out, ((base + step) % self.num_orients, y, x), share * magnitude)
        return out
