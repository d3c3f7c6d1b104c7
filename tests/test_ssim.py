"""Structural dissimilarity against a direct computation on arrays."""

import numpy as np
import pytest

from orbitlake.operators import kernels, tiles
from orbitlake.sources import fixtures

DATA = "/root/testdata/sf0.001"


def direct(u, v):
    w = np.exp(-np.arange(-5, 6) ** 2 / 4.5)
    w /= w.sum()

    def smooth(a):
        for axis in (0, 1):
            a = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 5, mode="symmetric"), w, "valid"), axis, a)
        return a

    mu, mv = smooth(u), smooth(v)
    cov = smooth(u * v) - mu * mv
    s = (2 * mu * mv + 1e-4) * (2 * cov + 9e-4) / ((mu**2 + mv**2 + 1e-4) * (smooth(u * u) - mu**2 + smooth(v * v) - mv**2 + 9e-4))
    return np.clip(1 - s, 0, 1)


def test_against_arrays(spark):
    found = {r["scene_id"]: (r["mean"], r["most"]) for r in kernels.QUERIES["j4_ssim_dissimilarity"](spark, DATA).collect()}
    pixels = tiles.tiles_to_pixels(fixtures.tiles(spark, DATA)).toPandas().sort_values(["scene_id", "y", "x"])
    assert set(found) == set(pixels["scene_id"])
    for scene, rows in pixels.groupby("scene_id"):
        u, v = (((0.299 * rows[f"r{i}"] + 0.587 * rows[f"g{i}"] + 0.114 * rows[f"b{i}"]) / 255).to_numpy().reshape(rows["h"].iloc[0], -1) for i in (1, 2))
        d = direct(u, v)
        assert np.allclose(found[scene], (d.mean(), d.max()), atol=2e-6)


def test_windows_have_odd_sides():
    for side, n in ((10, 30), (11, 9)):
        with pytest.raises(ValueError):
            kernels.ssim_dissimilarity(np.zeros((1, n, n)), np.zeros((1, n, n)), side)
