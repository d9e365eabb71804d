"""Local features from the responses of a sketch to a bank of oriented Gabor filters (dark strokes on white)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lumenary.descriptors import luminance, register, scaled_to
from lumenary.descriptors.local import local_histograms
from lumenary.descriptors.samplers import sample


def fast_size(n: int) -> int:
    """The least number from n on without other prime factors than 2, 3 and 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def gabor(size: int, peak: float, theta: float, along: float, across: float) -> np.ndarray:
    """[v, u] in the frequency domain: a Gaussian around `peak` cycles a pixel in the direction theta, folded in from the neighbouring periods."""
    axis = np.arange(-size, 2 * size) / size
    u, v = axis[None, :], axis[:, None]
    ur, vr = u * np.cos(theta) - v * np.sin(theta), u * np.sin(theta) + v * np.cos(theta)
    whole = np.exp(-2 * np.pi**2 * (((ur - peak) * along) ** 2 + (vr * across) ** 2))
    return whole.reshape(3, size, 3, size).sum(axis=(0, 2))


@register("galif")
@dataclass
class Galif:
    """features (tiles x tiles x num_orients), positions in [0, 1] and their number; patches without a stroke have none.

    The image is scaled to a longest side of image_width and laid at the origin of a white square that leaves three
    widths of the filter. line_width is a fraction of image_width; the filter is `lambda_` times as wide across its direction.
    """

    image_width: int = 256
    num_orients: int = 4
    peak_frequency: float = 0.1
    line_width: float = 0.02
    lambda_: float = 0.3
    feature_size: float = 0.1
    tiles: int = 4
    smooth_hist: bool = True
    normalize_hist: str = "l2"
    sampler: str = "grid"
    num_samples: int | None = None

    schema = "features array<array<float>>, positions array<array<float>>, numfeatures int"

    def __post_init__(self) -> None:
        along = self.line_width * self.image_width
        self._size = fast_size(int(self.image_width + 3 * max(along, self.lambda_ * along)))
        self._bank = np.stack([gabor(self._size, self.peak_frequency, np.pi * i / self.num_orients, along, self.lambda_ * along) for i in range(self.num_orients)])
        self._bank[:, 0, 0] = 0

    def compute(self, image: np.ndarray) -> dict:
        grey = scaled_to(luminance(image), self.image_width, self.image_width)
        height, width = grey.shape
        canvas = np.ones((self._size, self._size))
        canvas[:height, :width] = grey / 255
        responses = np.abs(np.fft.ifft2(np.fft.fft2(canvas) * self._bank))[:, :height, :width]
        points = sample(self.sampler, width, height, self.num_samples)
        return local_histograms(responses, grey, points, self.tiles, self.feature_size, self.smooth_hist, self.normalize_hist, canvas.shape)
