"""Image feature generators by name, run over image rows in Arrow batches.

A generator is a class with a `schema` (of its outputs) and `compute(image) -> dict`, image being a BGR uint8 array
[height, width, 3]; its fields are its parameters. Register one with @register("name").
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GENERATORS: dict[str, type] = {}


def register(name: str) -> Callable[[type], type]:
    def keep(cls: type) -> type:
        GENERATORS[name] = cls
        return cls

    return keep


def create(name: str, **parameters: object) -> object:
    """The generator of that name; unknown names and parameters are errors, missing parameters take their defaults."""
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name!r}; known: {', '.join(sorted(GENERATORS))}")
    return GENERATORS[name](**parameters)


def parameters_json(name: str, generator: object) -> str:
    """The effective parameters, defaults filled in."""
    return json.dumps({"generator": {"name": name} | asdict(generator)})


def read_parameters(path: str) -> tuple[str | None, dict[str, object]]:
    """(generator's name if given, parameters) of a JSON file {"generator": {"name": ..., parameter: value, "sampler": {"name", "num_samples"}}}."""
    with open(path, encoding="utf-8") as f:
        given = dict(json.load(f).get("generator", {}))
    sampler = given.pop("sampler", None)
    if isinstance(sampler, dict):
        given |= {k: v for k, v in (("sampler", sampler.get("name")), ("num_samples", sampler.get("num_samples"))) if v is not None}
    elif sampler is not None:
        given["sampler"] = sampler
    if "lambda" in given:
        given["lambda_"] = given.pop("lambda")
    return given.pop("name", None), given


def three_channels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """BGR pixels: one channel is repeated, a fourth is dropped."""
    m = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(m, 3, axis=2) if channels == 1 else m[:, :, :3]


def area_resize(m: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each target pixel is the mean over the area it covers, with fractions of pixels at its borders."""

    def weights(n: int, k: int) -> np.ndarray:
        edge = np.linspace(0, n, k + 1)
        lo, hi = np.arange(n), np.arange(1, n + 1)
        return np.maximum(0, np.minimum(edge[1:, None], hi) - np.maximum(edge[:-1, None], lo)) * (k / n)

    return np.einsum("yh,hwc,xw->yxc", weights(m.shape[0], height), m.astype(np.float64), weights(m.shape[1], width), optimize=True)


def luminance(image: np.ndarray) -> np.ndarray:
    """Grey values [height, width, 1] of BGR pixels."""
    return np.rint(image @ np.array([0.114, 0.587, 0.299])[:, None])


def scaled_to(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """A grey image [h, w, 1] scaled by the factor that brings its longer side to `width` (if it is the width) or `height`; whole values [h, w]."""
    h, w = grey.shape[:2]
    factor = width / w if w > h else height / h
    return np.rint(area_resize(grey, max(1, round(w * factor)), max(1, round(h * factor)))[:, :, 0])


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (white D65) of sRGB values in [0, 1]."""
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    # fixed values: sRGB to XYZ, each row divided by the white point
    xyz = linear @ (np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]) / np.array([[0.950456], [1.0], [1.088754]])).T
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    y = xyz[..., 1]
    light = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    return np.stack([light, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


@register("tinyimage")
@dataclass
class TinyImage:
    """A thumbnail's colour values by row: L*a*b* (lab), the stored triples in [0, 1] (rgb), or one luminance value a pixel (grey).

    Pixels are stored BGR. As the descriptor's definition has it, lab takes the stored triple for RGB; grey uses the weights of BGR.
    """

    width: int = 16
    height: int = 16
    colorspace: str = "lab"

    schema = "features array<float>"

    def compute(self, image: np.ndarray) -> dict:
        small = area_resize(image, self.width, self.height) / 255
        if self.colorspace == "grey":
            small = small @ np.array([0.114, 0.587, 0.299])
        elif self.colorspace == "lab":
            small = to_lab(small)
        elif self.colorspace != "rgb":
            raise ValueError(f"unknown colorspace {self.colorspace!r}")
        return {"features": small.astype(np.float32).ravel()}


def compute_descriptors(images: DataFrame, name: str, key: str = "image_id", **parameters: object) -> DataFrame:
    """(key, outputs of the generator) of image rows (key, image STRUCT of the image source); undecodable images have null outputs."""
    generator = create(name, **parameters)
    fields = [f.strip().split(" ", 1)[0] for f in generator.schema.split(", ")]
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h, w, c, d in b.itertuples(index=False):
                got = generator.compute(three_channels(d, h, w, c)) if h > 0 and w > 0 else dict.fromkeys(fields)
                out.append((k, *(got[f] for f in fields)))
            yield pd.DataFrame(out, columns=[key, *fields])

    return images.select(key, "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, f"`{key}` {kind}, {generator.schema}")


from lumenary.descriptors import galif, gist, shog  # noqa: E402, F401  (they register themselves)
