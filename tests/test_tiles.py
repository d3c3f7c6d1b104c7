"""Kernels over tiles of any size against the same on whole scenes, and what tiles must not be."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException

from orbitlake.operators import kernels
from orbitlake.operators import tiles as T
from orbitlake.sources import fixtures

DATA = "/root/testdata/sf0.001"


def scene(rng, h, w):
    return [rng.integers(0, m, (h, w, d), dtype=np.uint8) for d, m in ((3, 256), (3, 256), (1, 2))]


def cut(spark, scenes, size):
    rows = []
    for i, images in scenes.items():
        h, w = images[0].shape[:2]
        for ty in range(-(-h // size)):
            for tx in range(-(-w // size)):
                at = slice(ty * size, (ty + 1) * size), slice(tx * size, (tx + 1) * size)
                rows.append((i, ty, tx, size, h, w, *(bytearray(np.ascontiguousarray(a[at]).tobytes()) for a in images)))
    return spark.createDataFrame(rows, T.TILE_SCHEMA)


def some(n=7, seed=1):
    rng = np.random.default_rng(seed)
    return {i: scene(rng, int(rng.integers(1, 50)), int(rng.integers(1, 50))) for i in range(n)} | {99: scene(rng, 40, 3)}


def bordered(a, m):
    return np.pad(a, ((m, m), (m, m), (0, 0)), mode="symmetric")


def whole(images, margin):
    h, w = images[0].shape[:2]
    one = np.array([0])
    return T.Stack(one, one, one, one, one, np.array([h]), np.array([w]), margin, *(bordered(a, margin)[None] for a in images[:2]), images[2][None, ..., 0])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [4, 16, 64])
def test_signals_do_not_depend_on_tiles(spark, size):
    scenes, names = some(), ["p", "s_reg", "s_illum", "s_sharp", "margin"]
    found = {r["scene_id"]: r for r in T.means(cut(spark, scenes, size), 8, kernels.signals, names, size).collect()}
    for i, images in scenes.items():
        direct = kernels.signals(whole(images, 8))
        assert found[i]["n"] == direct["p"].size
        for name in names:
            assert np.isclose(found[i][f"{name}_sum"], direct[name].sum()) and np.isclose(found[i][f"{name}_most"], direct[name].max())


def test_matrix_does_not_depend_on_tiles(spark):
    scenes = some(4)
    assert rows(kernels.robustness_matrix(cut(spark, scenes, 16), 16)) == rows(kernels.robustness_matrix(cut(spark, scenes, 64), 64))


def test_matrix_is_made_once(spark):
    found = kernels.robustness_matrix(cut(spark, some(4), 16), 16)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()  # the rows are there, for themselves and for the control


def test_moved_images_reflect_beyond_the_scene(spark):
    images = some(1, 3)[99]
    s = whole(images, 10)
    for by in (1, 3, 5):
        alone = kernels.moved(bordered(images[1], 5)[None], by, 5)[0]
        assert (kernels.moved_around(s, s.t2, by, 5)[0] == bordered(alone, 5)).all()


def test_signals_by_other_means():
    """Stencils and boxes by sums over shifted copies."""
    images = scene(np.random.default_rng(5), 23, 31)
    found = kernels.signals(whole(images, 8))
    u, v = (np.pad((a @ np.array([0.2989, 0.587, 0.114])) / 255, 9, mode="symmetric") for a in images[:2])

    def stencil(a, taps):
        r = 1
        n = (slice(r, -r), slice(r, -r))
        return sum(t * np.roll(a, (-dy, -dx), (0, 1))[n] for (dy, dx), t in taps.items())

    def box(a):
        return sum(np.roll(a, (dy, dx), (0, 1)) for dy in range(-7, 8) for dx in range(-7, 8)) / 225

    sx = {(-1, -1): -1, (0, -1): -2, (1, -1): -1, (-1, 1): 1, (0, 1): 2, (1, 1): 1}
    edges = [np.hypot(stencil(a, sx), stencil(a, {(x, y): t for (y, x), t in sx.items()}))[8:-8, 8:-8] for a in (u, v)]
    light = [box(a)[9:-9, 9:-9] for a in (u, v)]
    sharp = [box(stencil(a, {(0, 0): -4, (0, 1): 1, (1, 0): 1, (0, -1): 1, (-1, 0): 1}) ** 2)[8:-8, 8:-8] for a in (u, v)]
    for name, (a, b) in (("s_reg", edges), ("s_illum", light), ("s_sharp", sharp)):
        assert np.allclose(found[name][0], np.abs(a - b) / (a + b + 1e-4))


def test_identical_pairs_have_no_discrepancy():
    images = scene(np.random.default_rng(6), 20, 20)
    found = kernels.signals(whole([images[0], images[0], images[2]], 8))
    assert all((found[n] == 0).all() for n in ("p", "s_reg", "s_illum", "s_sharp", "margin"))
    p = np.linspace(0, 1, 11)
    assert (kernels.gated(p, 0, 1.0, p) == p).all() and (kernels.gated(p, 0.6, 1.0, p) <= p).all()


def test_morphology(spark):
    mask = np.zeros((1, 20, 20), np.uint8)
    mask[0, 4:9, 4:9], mask[0, 4:9, 10:15], mask[0, 15, 15] = 1, 1, 1
    around = np.pad(mask, ((0, 0), (4, 4), (4, 4)), mode="symmetric")
    clean = kernels.morphology(around)[0]
    assert clean[4:9, 4:15].all() and clean.sum() == 55  # a gap of one pixel is bridged, a single pixel goes
    assert (kernels.morphology(mask, 1, 1) == mask).all()
    with pytest.raises(ValueError):
        kernels.morphology(mask, 2, 3)


@pytest.mark.parametrize("radius", [1, 4])
def test_shifts(spark, radius):
    found = kernels.estimate_shift(kernels.displaced(fixtures.tiles(spark, DATA, 16), radius, 16), radius, 16)
    assert all((r["dy"], r["dx"]) == (r["scene_id"] % (2 * radius + 1) - radius, r["scene_id"] % radius) for r in found.collect())


def test_patch_counts(spark):
    counts = lambda side, size, stride, pad: T.patches(size, stride, pad).count(side)
    assert [counts(1024, 256, 256, False), counts(1024, 256, 128, False), counts(300, 256, 256, True), counts(300, 256, 256, False), counts(20, 32, 32, False), counts(20, 32, 32, True)] == [4, 7, 2, 1, 0, 1]


def test_patches_of_a_known_change(spark):
    h = np.zeros((64, 64, 1), np.uint8)
    h[40:50, 20:28] = 1
    image = np.full((64, 64, 3), 9, np.uint8)
    found = T.extract_patches(cut(spark, {1: [image, image, h]}, 32), 40, 40, True, 5).collect()
    assert {(r["patch"], r["y"], r["x"], r["is_padded"], r["changed"]) for r in found} == {(0, 0, 0, False, 0), (1, 0, 40, True, 0), (2, 40, 0, True, 80), (3, 40, 40, True, 0)}
    last = next(np.frombuffer(r["t1"], np.uint8).reshape(40, 40, 3) for r in found if r["patch"] == 3)
    assert (last[:24, :24] == 9).all() and (last[24:] == 5).all() and (last[:, 24:] == 5).all()


@pytest.mark.parametrize(("size", "stride", "pad"), [(8, 8, True), (8, 5, False), (12, 12, False), (7, 3, True)])
def test_reconstruction(spark, size, stride, pad):
    """Overlaps are means, half to even; borders without a patch repeat the last covered column, then row."""
    rng = np.random.default_rng(size)
    scenes = {1: (29, 41), 2: (12, 12), 3: (40, 13)}
    n = {i: [T.patches(size, stride, pad).count(x) for x in hw] for i, hw in scenes.items()}
    made = [(i, ky * n[i][1] + kx, ky * stride, kx * stride, size, *hw, *(bytearray(a.tobytes()) for a in scene(rng, size, size))) for i, hw in scenes.items() for ky in range(n[i][0]) for kx in range(n[i][1])]
    frame = spark.createDataFrame(made, "scene_id long, patch int, y int, x int, size int, h int, w int, t1 binary, t2 binary, label binary")
    pixels = T.tiles_to_pixels(T.reconstruct(frame, stride, pad, 16)).toPandas()
    for i, (h, w) in scenes.items():
        sums, times = np.zeros((h + size, w + size, 3)), np.zeros((h + size, w + size, 1))
        for r in made:
            if r[0] == i:
                at = slice(r[2], r[2] + size), slice(r[3], r[3] + size)
                sums[at] += np.frombuffer(r[8], np.uint8).reshape(size, size, 3)
                times[at] += 1
        bottom, right = (min(x, (k - 1) * stride + size) for x, k in zip((h, w), n[i], strict=True))
        want = np.rint(sums[:bottom, :right] / times[:bottom, :right])
        want = np.pad(want, ((0, h - bottom), (0, w - right), (0, 0)), mode="edge")
        got = pixels[pixels["scene_id"] == i].sort_values(["y", "x"])[["r2", "g2", "b2"]].to_numpy().reshape(h, w, 3)
        assert (got == want).all()
    with pytest.raises(PythonException, match="patches over tile"):
        T.reconstruct(frame.where("NOT (scene_id = 1 AND patch = 1)"), stride, pad, 16).collect()


def test_forms_change_into_each_other(spark):
    frame = cut(spark, some(), 16)
    pixels = T.tiles_to_pixels(frame)
    assert rows(T.pixels_to_tiles(pixels, 16)) == rows(frame)
    assert rows(T.tiles_to_pixels(T.pixels_to_tiles(pixels, 5))) == rows(pixels)
    with pytest.raises(PythonException, match="aren't those of its place"):
        T.pixels_to_tiles(pixels.where("NOT (scene_id = 99 AND y = 3 AND x = 1)"), 16).collect()
    with pytest.raises(PythonException, match="no bytes"):
        T.pixels_to_tiles(pixels.selectExpr("scene_id", "h", "w", "y", "x", "r1 + 1 AS r1", "g1", "b1", "r2", "g2", "b2", "gt"), 16).collect()


@pytest.mark.parametrize("size", [5, 16])
def test_scenes_as_a_whole_and_by_tiles(spark, monkeypatch, size):
    """Small scenes are put together, larger ones are not; results are the same."""
    scenes = some(6, 4)
    frame = cut(spark, scenes, size)
    jobs = {
        "matrix": lambda: kernels.robustness_matrix(frame, size),
        "grid": lambda: kernels.gate_grid(frame, size),
        "ablation": lambda: kernels.gating_ablation(frame, size, 0.2, 0.4),
        "shift": lambda: kernels.estimate_shift(kernels.displaced(frame, 2, size), 2, size),
        "patches": lambda: T.extract_patches(frame, 9, 5, True, 7),
        "again": lambda: T.reconstruct(T.extract_patches(frame, 4, 3, False), 3, False, 7),
    }
    entire = {name: rows(job()) for name, job in jobs.items()}
    monkeypatch.setattr(T, "WHOLE", 0)
    for name, job in jobs.items():
        assert rows(job()) == entire[name], name


def test_no_border_no_shuffle(spark):
    kernel = lambda s: pa.RecordBatch.from_pydict({"scene_id": pa.array(s.scene), "n": pa.array(np.full(len(s.scene), s.label[0].size))})
    frame = cut(spark, some(), 16)
    found = T.over_tiles(frame, 0, kernel, "scene_id long, n long", 16)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sum(r["n"] for r in found.collect()) == sum(a[2].size for a in some().values())


def test_a_tile_there_twice_is_an_error(spark):
    frame = cut(spark, some(), 16)
    with pytest.raises(PythonException, match="tile 1, 0"):
        kernels.gate_grid(frame.unionByName(frame.where("scene_id = 99 AND ty = 1")), 16).collect()


def test_folded_weights():
    a, w = np.random.default_rng(8).random((3, 5, 17)), kernels.gaussian(4)
    assert np.allclose(T.folded(a, w), T.weighed(np.pad(a, ((0, 0), (16, 16), (16, 16)), mode="symmetric"), w))  # farther than a side


def test_tiles_have_to_be_whole(spark):
    frame = cut(spark, some(), 16)
    mean = lambda f: T.means(f, 3, lambda s: {"v": kernels.pixel_diff(s.near(s.t1), s.near(s.t2))}, ["v"], 16)
    assert mean(frame).count() == 8
    with pytest.raises(PythonException, match="around tile"):
        mean(frame.where("NOT (scene_id = 99 AND ty = 1)")).collect()
    with pytest.raises(PythonException, match="bytes for"):
        mean(frame.selectExpr("scene_id", "ty", "tx", "size", "h", "w", "t1", "substring(t2, 2) AS t2", "label")).collect()
    assert mean(frame.limit(0)).count() == 0
