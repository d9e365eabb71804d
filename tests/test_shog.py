"""The drawing descriptor on images whose result is known."""

import numpy as np
import pytest

from lumenary import descriptors
from lumenary.descriptors import local, shog


def drawing(vertical):
    m = np.full((64, 64, 3), 255, np.uint8)
    m[:, 30:33] = 0
    return m if vertical else m.transpose(1, 0, 2)


def test_blur_and_gradients_of_simple_images():
    assert local.blur(np.full((9, 5), 3.0), local.gaussian(7, 2.0)) == pytest.approx(np.full((9, 5), 3.0))
    assert local.blur(np.arange(9.0)[:, None] * np.ones(6), np.full(3, 1 / 3))[1:-1] == pytest.approx((np.arange(9.0)[:, None] * np.ones(6))[1:-1])
    gx, gy = shog.gradients(np.arange(5.0) * np.ones((4, 1)))
    assert (gx[:, 1:-1] == 8).all()
    assert (gy == 0).all()


def test_empty_drawings_have_no_features():
    got = descriptors.create("shog").compute(np.full((40, 60, 3), 255, np.uint8))
    assert got == {"features": [], "positions": [], "numfeatures": 0}


def test_features_are_unit_and_turn_with_the_drawing():
    one, two = (descriptors.create("shog", image_width=64, num_samples=49).compute(drawing(v)) for v in (True, False))
    assert one["numfeatures"] == len(one["features"]) == len(one["positions"]) > 0
    a, b = np.array(one["features"]), np.array(two["features"])
    assert a.shape[1] == 64
    assert np.linalg.norm(a, axis=1) == pytest.approx(1, abs=1e-4)
    strongest = [x.reshape(-1, 4).sum(axis=0) for x in (a, b)]
    # a gradient along x lies on the border of the two middle bins, one along y on that of the first and the last
    assert strongest[0][1] + strongest[0][2] > 0.9 * strongest[0].sum()
    assert strongest[1][0] + strongest[1][3] > 0.9 * strongest[1].sum()
    assert (np.array(one["positions"]) < 1).all()


def test_energy_is_the_gradient():
    m = np.rint(local.blur(drawing(True)[:, :, 0].astype(float), local.gaussian(7, 2.0)))
    gx, gy = shog.gradients(m)
    assert descriptors.create("shog")._energy(drawing(True)[:, :, 0].astype(float)).sum(axis=0) == pytest.approx(np.hypot(gx, gy))
