"""The Gabor descriptors, the samplers and the colours, on images whose result is known."""

import json

import numpy as np
import pytest

from lumenary import descriptors
from lumenary.descriptors import galif, gist, local, samplers


def stripes(period, vertical=True, size=64):
    m = 127.5 + 127.5 * np.cos(2 * np.pi * np.arange(size) / period) * np.ones((size, 1))
    return np.repeat((m if vertical else m.T)[:, :, None], 3, axis=2).astype(np.uint8)


def drawing(vertical):
    m = np.full((64, 64, 3), 255, np.uint8)
    m[:, 30:33] = 0
    return m if vertical else m.transpose(1, 0, 2)


def test_gist_names_the_frequency_and_the_direction():
    g = descriptors.create("gist", width=64, height=64, padding=16, prefilter="none")
    assert len(g.compute(stripes(8))["features"]) == 768
    for vertical, orient in ((True, 0), (False, 3)):
        mean = g.compute(stripes(8, vertical))["features"].reshape(4, 6, 16, 2)[..., 0].mean(axis=2)
        assert np.unravel_index(mean.argmax(), mean.shape)[1] == orient
    peaks = [g.compute(stripes(p))["features"].reshape(4, 6, 16, 2)[:, 0, :, 0].mean(axis=1).argmax() for p in (4, 16)]
    assert peaks[0] < peaks[1]
    flat = g.compute(np.full((40, 64, 3), 90, np.uint8))["features"]
    assert np.abs(flat).max() < 1e-6
    plane = descriptors.create("gist", width=64, height=64, padding=16, prefilter="none", polar=False).compute(stripes(8, False))["features"].reshape(4, 6, 16, 2)[..., 0].mean(axis=2)
    assert np.unravel_index(plane.argmax(), plane.shape)[1] == 3


def test_gist_prefilter_and_margin():
    g = descriptors.create("gist", width=32, height=32, padding=8)
    dark, bright = (g.compute((stripes(8, size=32) // 4 + add).astype(np.uint8))["features"] for add in (20, 150))
    assert np.corrcoef(dark, bright)[0, 1] > 0.9
    assert gist.mirrored(np.arange(4.0)[:, None] * np.ones(2), 8, 2)[:, 0].tolist() == [0, 1, 2, 3, 3, 2, 1, 0]
    assert gist.mirrored(np.arange(3.0)[None, :], 1, 7)[0].tolist() == [0, 1, 2, 2, 1, 1, 0]
    with pytest.raises(ValueError, match="prefilter"):
        descriptors.create("gist", prefilter="x")


def test_galif_finds_the_direction_of_strokes():
    one, two = (descriptors.create("galif", image_width=64, num_samples=49).compute(drawing(v)) for v in (True, False))
    a, b = np.array(one["features"]), np.array(two["features"])
    assert a.shape[1] == 64
    assert one["numfeatures"] == len(a) == len(one["positions"]) > 0
    assert np.linalg.norm(a, axis=1) == pytest.approx(1, abs=1e-4)
    assert a.reshape(-1, 4).sum(axis=0).argmax() == 0
    assert b.reshape(-1, 4).sum(axis=0).argmax() == 2
    assert descriptors.create("galif", image_width=64).compute(np.full((40, 60, 3), 255, np.uint8)) == {"features": [], "positions": [], "numfeatures": 0}
    raw = descriptors.create("galif", image_width=64, num_samples=49, normalize_hist="none", smooth_hist=False).compute(drawing(True))
    assert np.array(raw["features"]).max() > 1.5
    lowe = np.array(descriptors.create("galif", image_width=64, num_samples=49, normalize_hist="lowe").compute(drawing(True))["features"])
    assert lowe.sum(axis=1) == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError, match="normalisation"):
        descriptors.create("galif", image_width=64, normalize_hist="x").compute(drawing(True))
    assert [galif.fast_size(n) for n in (1, 7, 11, 271)] == [1, 8, 12, 288]


def test_box_sums():
    m = np.arange(20.0).reshape(4, 5)
    assert local.box_sum(m, 2)[2, 3] == m[1:3, 2:4].sum()
    assert local.box_sum(m, 3)[2, 3] == m[1:4, 2:5].sum()


def test_samplers():
    assert samplers.sample("grid", 26, 26).shape == (625, 2)
    p = samplers.sample("random_area", 10, 20)
    assert p.shape == (500, 2)
    assert (p.max(axis=0) < [10, 20]).all()
    assert (p == samplers.sample("random_area", 10, 20)).all()
    with pytest.raises(ValueError, match="sampler"):
        samplers.sample("x", 1, 1)
    assert descriptors.create("shog", image_width=64, sampler="random_area", num_samples=30).compute(drawing(True))["numfeatures"] <= 30


def test_lab_colours():
    assert descriptors.to_lab(np.ones(3)) == pytest.approx([100, 0, 0], abs=0.01)
    assert descriptors.to_lab(np.zeros(3)) == pytest.approx([0, 0, 0], abs=0.01)
    assert descriptors.to_lab(np.array([1.0, 0, 0])) == pytest.approx([53.24, 80.09, 67.20], abs=0.05)
    assert descriptors.create("tinyimage").compute(drawing(True))["features"].shape == (768,)


def test_parameters_from_json(tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"generator": {"name": "galif", "lambda": 0.5, "sampler": {"name": "random_area", "num_samples": 7}}}))
    assert descriptors.read_parameters(str(path)) == ("galif", {"lambda_": 0.5, "sampler": "random_area", "num_samples": 7})
