"""Global features: mean and variance over tiles of an image's responses to Gabor filters of several frequencies and orientations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lumenary.descriptors import luminance, register, scaled_to


def mirrored(m: np.ndarray, height: int, width: int) -> np.ndarray:
    """m extended to height x width by mirroring (edges repeated) as on a torus: half of what is added continues the end, half leads to the beginning."""
    for size in (height, width):
        n = len(m)
        at = np.arange(max(size, n))
        at = np.where(at < n + (size - n) // 2, at, at - size) % (2 * n) if size > n else at
        m = m[np.where(at < n, at, 2 * n - 1 - at)].T
    return m


def low_pass(height: int, width: int, cycles: float) -> np.ndarray:
    """A Gaussian in the frequency domain that is one half at `cycles` cycles an image."""
    y, x = np.fft.fftfreq(height, 1 / height), np.fft.fftfreq(width, 1 / width)
    return np.exp(-(x[None, :] ** 2 + y[:, None] ** 2) * np.log(2) / cycles**2)


def whiten(image: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The logarithm's high frequencies, divided by their local contrast: whole numbers from 0 to 255."""
    white = np.fft.ifft2(np.fft.fft2(np.log1p(image)) * (1 - low)).real
    contrast = np.sqrt(np.abs(np.fft.ifft2(np.fft.fft2(white**2) * low).real)) + 0.2
    return np.floor(np.minimum(255 * np.maximum(white, 0) / contrast, 255))


def polar_filter(u: np.ndarray, v: np.ndarray, peak: float, ratio: float, angle: float, width: float) -> np.ndarray:
    """A Gaussian in the frequency's length (relative to peak) and direction."""
    spread = (ratio - 1) / ((ratio + 1) * np.sqrt(2 * np.log(2)))
    turn = np.arctan2(v, u) + angle
    turn = np.where(turn > np.pi, turn - 2 * np.pi, turn)
    return np.exp(-((np.hypot(u, v) / peak - 1) ** 2) / (2 * spread**2) - np.log(2) * (2 / width * turn) ** 2)


def plane_filter(u: np.ndarray, v: np.ndarray, peak: float, ratio: float, angle: float, width: float) -> np.ndarray:
    """A Gaussian around one frequency, its axes along and across the direction."""
    c, ka, kb = np.sqrt(np.log(2) / np.pi), (ratio - 1) / (ratio + 1), np.tan(width / 2)
    x, y = u - peak * np.cos(angle), -v - peak * np.sin(angle)
    along, across = x * np.cos(angle) + y * np.sin(angle), y * np.cos(angle) - x * np.sin(angle)
    return np.exp(-np.pi * ((along * c / (peak * ka)) ** 2 + (across * c / (kb * peak * np.sqrt(1 - ka * ka))) ** 2))


@register("gist")
@dataclass
class Gist:
    """features: [mean, variance] of the response's magnitude, by filter (frequency, then orientation), tile row and tile column.

    The image is scaled to a longest side of width (or height) and mirrored into a margin of `padding`; prefilter torralba evens out brightness
    and contrast. Frequencies fall from max_peak_freq by delta_freq_oct octaves; bandwidth_oct is as wide if not given.
    """

    padding: int = 64
    width: int = 256
    height: int = 256
    num_x_tiles: int = 4
    num_y_tiles: int = 4
    num_freqs: int = 4
    num_orients: int = 6
    max_peak_freq: float = 0.3
    delta_freq_oct: float = 0.88752527
    bandwidth_oct: float | None = None
    angle_factor: float = 1.0
    polar: bool = True
    prefilter: str = "torralba"

    schema = "features array<float>"

    def __post_init__(self) -> None:
        if self.prefilter not in ("torralba", "none"):
            raise ValueError(f"unknown prefilter {self.prefilter!r}; known: none, torralba")
        if self.bandwidth_oct is None:
            self.bandwidth_oct = self.delta_freq_oct
        high, wide = self.height + self.padding, self.width + self.padding
        self._low = low_pass(high, wide, 4 * wide / self.width) if self.prefilter == "torralba" else None
        u, v = np.fft.fftfreq(wide)[None, :], np.fft.fftfreq(high)[:, None]
        most = max(high, wide)
        peak, step = self.max_peak_freq * most / (most + self.padding), np.pi / self.num_orients
        build = polar_filter if self.polar else plane_filter
        bank = [build(u, v, peak / 2 ** (self.delta_freq_oct * i), 2**self.bandwidth_oct, k * step, step * self.angle_factor) for i in range(self.num_freqs) for k in range(self.num_orients)]
        self._bank = np.stack(bank)
        self._bank[:, 0, 0] = 0

    def compute(self, image: np.ndarray) -> dict:
        small = scaled_to(luminance(image), self.width, self.height)
        padded = mirrored(small, *self._bank.shape[1:])
        if self._low is not None:
            padded = whiten(padded, self._low)
        response = np.abs(np.fft.ifft2(np.fft.fft2(padded / 255) * self._bank))
        rows, columns = small.shape[0] // self.num_y_tiles, small.shape[1] // self.num_x_tiles
        tiles = response[:, : rows * self.num_y_tiles, : columns * self.num_x_tiles].reshape(len(response), self.num_y_tiles, rows, self.num_x_tiles, columns)
        return {"features": np.stack([tiles.mean(axis=(2, 4)), tiles.var(axis=(2, 4))], axis=-1).astype(np.float32).ravel()}
