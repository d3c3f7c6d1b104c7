"""Differences, perturbations, quality signals and their gates, as kernels over tiles."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.functions.lineage import stored
from orbitlake.operators import tile_sql
from orbitlake.operators import tiles as T
from orbitlake.operators.evaluation import with_metrics
from orbitlake.operators.raster import CUT
from orbitlake.sources import fixtures

#: Side of the tiles that queries read.
SIZE = 32
# fixed values: luma weights of signals and of the structural similarity, its stabilisers, weights of the signals, thresholds and grids
LUMA, SSIM_LUMA, SSIM_C = (0.2989, 0.587, 0.114), (0.299, 0.587, 0.114), (1e-4, 9e-4)
WEIGHTS = {"s_reg": 0.34, "s_illum": 0.33, "s_sharp": 0.33}
GAMMA, TAU = 0.3, 0.45
GAMMAS, TAUS = [i / 10 for i in range(7)], [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]
FROZEN = {"pixel_diff": 0.41, "ssim": 0.9, "cva": 0.405}
SEVERITIES = ("mild", "medium", "strong")
LIGHT, BLUR, SHIFT, SHADOW, DIMMED = (0.05, 0.15, 0.25), (1, 2, 4), (1, 3, 5), (0.02, 0.05, 0.1), 0.4
SEED = 42


def gaussian(sigma: float, radius: int | None = None) -> list[float]:
    """Weights at distances 0 to ``radius`` (4 sigma); with both sides they add up to 1."""
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range((int(4 * sigma + 0.5) if radius is None else radius) + 1)]
    return [x / (w[0] + 2 * sum(w[1:])) for x in w]


def _over_channels(a: np.ndarray) -> np.ndarray:
    return a[..., 0] + a[..., 1] + a[..., 2]


def pixel_diff(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _over_channels(np.abs(a.astype(np.int16) - b)) / 765


def cva(a: np.ndarray, b: np.ndarray, normalize: bool = True) -> np.ndarray:
    """Length of the change vector, at most 1; over the root of the channels with ``normalize``."""
    square = _over_channels((a.astype(np.int32) - b) ** 2)
    return np.minimum(1, np.sqrt(square / ((3 if normalize else 1) * 65025)))


def ssim_moments(u: np.ndarray, side: int = 11, sigma: float = 1.5, mean=T.weighed) -> tuple[np.ndarray, np.ndarray]:
    """Means of an image and of its square within gaussian windows; takes ``side`` // 2 pixels off, unless ``mean`` folds. An even side is an error."""
    if side % 2 == 0 or (mean is T.weighed and min(u.shape[1:]) < side):
        raise ValueError("windows have an odd side that the images hold")
    w = gaussian(sigma, side // 2)
    return mean(u, w), mean(u * u, w)


def ssim_dissimilarity(u: np.ndarray, v: np.ndarray, side: int = 11, sigma: float = 1.5, known: tuple[np.ndarray, np.ndarray] | None = None, mean=T.weighed) -> np.ndarray:
    """1 - SSIM within gaussian windows, clipped to [0, 1]; takes ``side`` // 2 pixels off, unless ``mean`` folds. ``known`` are the moments of ``u``, if they are there already."""
    (mu, uu), (mv, vv) = known or ssim_moments(u, side, sigma, mean), ssim_moments(v, side, sigma, mean)
    (c1, c2), uv, mm, m2 = SSIM_C, mean(u * v, gaussian(sigma, side // 2)), mu * mv, mu * mu + mv * mv
    top = (2 * mm + c1) * (2 * (uv - mm) + c2)
    return np.clip(1 - top / ((m2 + c1) * (uu + vv - m2 + c2)), 0, 1)


def ssim_by_channel(a: np.ndarray, b: np.ndarray, mean=T.weighed) -> np.ndarray:
    return sum(ssim_dissimilarity(a[..., c] / 255, b[..., c] / 255, mean=mean) for c in range(3)) / 3


def lit(image: np.ndarray, share: float) -> np.ndarray:
    return np.clip(np.rint(image + 255 * share), 0, 255).astype(np.uint8)


def blurred(image: np.ndarray, sigma: float, mean=T.weighed) -> np.ndarray:
    """Takes 4 sigma off, unless ``mean`` folds."""
    w = gaussian(sigma)
    channels = np.moveaxis(image, 3, 0).reshape(-1, *image.shape[1:3]).astype(np.float64)
    found = np.clip(np.rint(mean(channels, w)), 0, 255).astype(np.uint8)
    return np.moveaxis(found.reshape(3, -1, *found.shape[1:]), 0, 3)


def moved(image: np.ndarray, by: int, margin: int) -> np.ndarray:
    """The content ``by`` pixels down and to the right; takes ``margin`` off."""
    first = margin - by
    return image[:, first : image.shape[1] - margin - by, first : image.shape[2] - margin - by]


def moved_around(s: T.Stack, image: np.ndarray, by: int, margin: int) -> np.ndarray:
    """As ``moved``, with ``margin`` pixels around the tile, which beyond the scene reflect the moved image; ``image`` has by more around at least."""
    more = (image.shape[1] - s.label.shape[1]) // 2
    at = [inside(of(margin), side) - by - first[:, None] + more for of, side, first in ((s.rows, s.h, s.y0), (s.columns, s.w, s.x0))]
    if s.entire:
        at = [inside(a, side) for a, side in zip(at, (s.h, s.w), strict=True)]
    return image[np.arange(len(s.scene))[:, None, None], at[0][:, :, None], at[1][:, None, :]]


def inside(at: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Places along a side, those beyond it reflected."""
    v = at % (2 * side[:, None])
    return v - np.maximum(0, 2 * (v - side[:, None]) + 1)


@functools.lru_cache(1 << 15)
def _placed(seed: int, scene: int, axis: str) -> int:
    return int(hashlib.md5(f"shadow:{seed}:{scene}:{axis}".encode()).hexdigest()[:8], 16)


def shadow_box(h: np.ndarray, w: np.ndarray, share: float, scene: np.ndarray, seed: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(side, top, left) of a square of ``share`` of a scene: at 35 percent of what is left of its sides, or by ``seed`` anywhere."""
    side = np.clip(np.rint(np.sqrt(h * w * share)), 1, np.minimum(h, w)).astype(int)
    if seed is None:
        return side, np.rint((h - side) * 0.35).astype(int), np.rint((w - side) * 0.35).astype(int)
    at = [[_placed(seed, s, axis) % max(1, n) for s, n in zip(scene.tolist(), (of - side).tolist(), strict=True)] for axis, of in (("y", h), ("x", w))]
    return side, np.array(at[0]), np.array(at[1])


def in_shadow(s: T.Stack, margin: int, share: float, seed: int | None) -> np.ndarray:
    """The pixels of each tile, with ``margin`` around, that are within the shadow's box."""
    side, top, left = shadow_box(s.h, s.w, share, s.scene, seed)
    hit = [(v >= first[:, None]) & (v < (first + side)[:, None]) for v, first in ((inside(s.rows(margin), s.h), top), (inside(s.columns(margin), s.w), left))]
    return hit[0][:, :, None] & hit[1][:, None, :]


def darker(image: np.ndarray, dimmed: float = DIMMED) -> np.ndarray:
    return np.rint(np.arange(256) * dimmed).astype(np.uint8)[image]


def shaded(s: T.Stack, image: np.ndarray, margin: int, share: float, seed: int | None, dimmed: float = DIMMED) -> np.ndarray:
    """``image``, with ``margin`` pixels around the tile, darker within the shadow's box."""
    return np.where(in_shadow(s, margin, share, seed)[..., None], darker(image, dimmed), image)


def signals(s: T.Stack) -> dict[str, np.ndarray]:
    """Difference of the images, discrepancies of their edges, light and sharpness, and the difference's uncertainty; needs 8 pixels around."""
    u, v = (T.luma(s.near(t, 8), LUMA) for t in (s.t1, s.t2))
    apart = lambda a, b: np.abs(a - b) / (a + b + 1e-4)
    box = (lambda a: T.folded(a, [1 / 15] * 8)) if s.entire else (lambda a: T.box_mean(a, 7))
    cut = slice(s.out(1), -1 if s.out(1) else None)
    wide = [s.bordered(a, 1) for a in (u, v)]
    edges = [T.sobel(a[:, s.out(7) : a.shape[1] - s.out(7), s.out(7) : a.shape[2] - s.out(7)]) for a in wide]
    light = [box(a[:, cut, cut]) for a in (u, v)]
    sharp = [box(T.laplacian(a) ** 2) for a in wide]
    p = pixel_diff(s.near(s.t1), s.near(s.t2))
    return {"p": p, "s_reg": apart(*edges), "s_illum": apart(*light), "s_sharp": apart(*sharp), "margin": 4 * p * (1 - p)}


def defect(found: dict[str, np.ndarray], *active: str) -> np.ndarray:
    """Weighted mean of the active signals, 0 without any."""
    return sum(WEIGHTS[a] * found[a] for a in active) / sum(WEIGHTS[a] for a in active) if active else np.zeros_like(found["p"])


def gated(p: np.ndarray, gamma: float, margin: np.ndarray | float, q: np.ndarray) -> np.ndarray:
    return np.clip(p * (1 - gamma * margin * q), 0, 1)


def _counted(names: dict[str, list], counts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row for each name and tp, fp, fn, tn of (predicted, label) over a whole stack."""
    cm = []
    for p, y in counts:
        tp, over, set_ = (int(np.count_nonzero(a)) for a in (p & y, p, y))
        cm.append((tp, over - tp, set_ - tp, y.size - over - set_ + tp))
    columns = {k: pa.array(v) for k, v in names.items()} | {k: pa.array([c[i] for c in cm], pa.int64()) for i, k in enumerate(("tp", "fp", "fn", "tn"))}
    return pa.RecordBatch.from_pydict(columns)


def summed(rows: DataFrame, *by: str) -> DataFrame:
    return with_metrics(rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))


def gate_grid(tiles: DataFrame, size: int) -> DataFrame:
    """Counts and metrics of all gammas and thresholds, from one histogram of thresholds passed for each gamma and label of a stack."""

    def kernel(s: T.Stack) -> pa.RecordBatch:
        found = signals(s)
        q, y = defect(found, *WEIGHTS), s.label > 0
        rows = []
        for gamma in GAMMAS:
            passed = np.searchsorted(TAUS, gated(found["p"], gamma, found["margin"], q), "right")
            for gt in (0, 1):
                above = np.cumsum(np.bincount(passed[y == bool(gt)], minlength=len(TAUS) + 1)[::-1])[::-1]
                rows += [(gamma, tau, gt, int(above[i + 1]), int(above[0] - above[i + 1])) for i, tau in enumerate(TAUS)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["gamma", "tau", "gt", "over", "under"])

    found = T.over_tiles(tiles, 8, kernel, "gamma double, tau double, gt long, over long, under long", size, True)
    of = lambda column, gt: F.sum(F.when(F.col("gt") == gt, F.col(column)).otherwise(0))
    return with_metrics(found.groupBy("gamma", "tau").agg(of("over", 1).alias("tp"), of("over", 0).alias("fp"), of("under", 1).alias("fn"), of("under", 0).alias("tn")))


def gating_ablation(tiles: DataFrame, size: int, gamma: float, tau: float) -> DataFrame:
    """Seven conditions: gated with the calibrated ``gamma``; not at all, at the unadjusted threshold; with GAMMA and all signals, one, or all without the margin."""
    every = tuple(WEIGHTS)
    only = {"reg_only": ("s_reg",), "illum_only": ("s_illum",), "sharp_only": ("s_sharp",)}

    def kernel(s: T.Stack) -> pa.RecordBatch:
        found = signals(s)
        p, m = found["p"], found["margin"]
        hits = {"full": gated(p, gamma, m, defect(found, *every)) >= tau, "no_gate": p >= TAU, "all_signals": gated(p, GAMMA, m, defect(found, *every)) >= tau}
        hits |= {name: gated(p, GAMMA, m, defect(found, *active)) >= tau for name, active in only.items()}
        hits["no_uncertainty"] = gated(p, GAMMA, 1.0, defect(found, *every)) >= tau
        return _counted({"cond": list(hits)}, [(h, s.label > 0) for h in hits.values()])

    return summed(T.over_tiles(tiles, 8, kernel, "cond string, tp long, fp long, fn long, tn long", size, True), "cond")


def conditions(s: T.Stack, margin: int) -> dict[tuple[str, str], np.ndarray]:
    """The second image as it is and changed by four families at three severities, with ``margin`` pixels around; needs 16 more."""
    t2 = s.near(s.t2, margin)
    out = {("control", "none"): t2}
    for severity, light, sigma, by, share in zip(SEVERITIES, LIGHT, BLUR, SHIFT, SHADOW, strict=True):
        out["illumination", severity] = lit(t2, light)
        out["blur", severity] = blurred(s.near(s.t2, margin + 4 * sigma), sigma, s.weighed)
        out["misregistration", severity] = moved_around(s, s.near(s.t2, margin + 5), by, margin)
        out["occlusion", severity] = shaded(s, t2, margin, share, SEED)
    return out


def robustness_matrix(tiles: DataFrame, size: int) -> DataFrame:
    """Every detector at its frozen threshold in every condition, with what it loses against the control; the tiles are read once."""

    def kernel(s: T.Stack) -> pa.RecordBatch:
        m, y, names, hits = s.out(5), s.label > 0, [], []
        first = s.near(s.t1, m)
        u = T.luma(first, SSIM_LUMA)
        known = ssim_moments(u, mean=T.folded if s.entire else T.weighed)
        inner = (slice(None), *[slice(m, -m if m else None)] * 2)
        for (family, severity), second in conditions(s, m).items():
            ssim = ssim_dissimilarity(u, T.luma(second, SSIM_LUMA), known=known, mean=T.folded if s.entire else T.weighed)
            scores = {"pixel_diff": pixel_diff(first[inner], second[inner]), "ssim": ssim, "cva": cva(first[inner], second[inner])}
            for detector, score in scores.items():
                names.append((family, severity, detector))
                hits.append((score >= FROZEN[detector], y))
        return _counted(dict(zip(("family", "severity", "detector"), map(list, zip(*names, strict=True)), strict=True)), hits)

    schema = "family string, severity string, detector string, tp long, fp long, fn long, tn long"
    rows = summed(T.over_tiles(tiles, 21, kernel, schema, size, True), "detector", "family", "severity")
    return degradation(stored(rows))  # a row a condition; read twice, made once


def degradation(rows: DataFrame) -> DataFrame:
    """Adds to metrics by (detector, family, severity) what they lose against the family control: differences, shares in percent (0 where there is nothing to lose)."""
    control = rows.where("family = 'control'").select("detector", *[F.col(c).alias(f"{c}_c") for c in ("f1", "iou", "fp", "tn")])
    loss = lambda c: F.round(F.when(F.col(f"{c}_c") > 0, (F.col(f"{c}_c") - F.col(c)) / F.col(f"{c}_c") * 100).otherwise(0.0), 4)
    more = F.col("fp") - F.col("fp_c")
    share = lambda of: F.round(F.when(of > 0, more / of * 100).otherwise(0.0), 4)
    out = rows.join(F.broadcast(control), "detector")  # a row a detector
    out = out.withColumns({"f1_delta": F.round(F.col("f1") - F.col("f1_c"), 6), "f1_loss_pct": loss("f1"), "iou_delta": F.round(F.col("iou") - F.col("iou_c"), 6), "iou_loss_pct": loss("iou")})
    out = out.withColumns({"fp_more": more, "fp_more_pct": share(F.col("fp_c")), "fp_rate_pct": share(F.col("fp_c") + F.col("tn_c"))})
    return out.drop("f1_c", "iou_c", "fp_c", "tn_c")


def morphology(mask: np.ndarray, close: int = 3, open_: int = 3) -> np.ndarray:
    """``mask`` closed, then opened, by squares of odd sides (1: not at all); takes close // 2 + open // 2 off twice. An even side is an error."""
    if close % 2 == 0 or open_ % 2 == 0:
        raise ValueError("squares have odd sides")
    for side, steps in ((close, (np.maximum, np.minimum)), (open_, (np.minimum, np.maximum))):
        for f in steps:
            mask = T.extreme(mask, side // 2, f)
    return mask


def estimate_shift(tiles: DataFrame, radius: int, size: int) -> DataFrame:
    """(scene_id, dy, dx, err): where each scene's second image lies best over the first, by mean difference of luma on what both cover; ties to the shortest way."""

    def kernel(s: T.Stack) -> pa.RecordBatch:
        u, v = T.luma(s.near(s.t1), LUMA), T.luma(s.near(s.t2, radius), LUMA)
        y, x = s.rows(), s.columns()
        rows = []
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                there = ((y + dy >= 0) & (y + dy < s.h[:, None]))[:, :, None] & ((x + dx >= 0) & (x + dx < s.w[:, None]))[:, None, :]
                off = np.abs(u - v[:, radius + dy : radius + dy + u.shape[1], radius + dx : radius + dx + u.shape[2]])
                rows.append((s.scene, np.full(len(s.scene), dy), np.full(len(s.scene), dx), np.where(there, off, 0).sum(axis=(1, 2)), there.sum(axis=(1, 2))))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["scene_id", "dy", "dx", "off", "n"])

    found = T.over_tiles(tiles, radius, kernel, "scene_id long, dy long, dx long, off double, n long", size)
    errors = found.groupBy("scene_id", "dy", "dx").agg(F.round(F.sum("off") / F.sum("n"), 9).alias("err"))
    best = F.min(F.struct("err", (F.abs("dy") + F.abs("dx")).alias("way"), "dy", "dx")).alias("b")
    return errors.where("err IS NOT NULL").groupBy("scene_id").agg(best).select("scene_id", "b.dy", "b.dx", "b.err")


def displaced(tiles: DataFrame, radius: int, size: int) -> DataFrame:
    """Tiles whose second image is the first, moved by scene_id % (2 radius + 1) - radius down and scene_id % radius to the right."""

    def kernel(s: T.Stack) -> pa.RecordBatch:
        t1 = s.near(s.t1)
        dy, dx = s.scene % (2 * radius + 1) - radius, s.scene % radius
        rows, cols = (radius - d[:, None] + np.arange(n) for d, n in ((dy, t1.shape[1]), (dx, t1.shape[2])))
        t2 = s.near(s.t1, radius)[np.arange(len(dy))[:, None, None], rows[:, :, None], cols[:, None, :]]
        columns = []
        for y in range(0, t1.shape[1], size):  # a scene as a whole has several tiles
            for x in range(0, t1.shape[2], size):
                data = [[c.tobytes() for c in a[:, y : y + size, x : x + size]] for a in (t1, t2, s.label)]
                columns.append((s.scene, s.ty + y // size, s.tx + x // size, np.full(len(s.scene), size), s.h, s.w, *data))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if k != pa.binary() else [x for a in c for x in a], k) for c, k in zip(zip(*columns, strict=True), T.TILE_KINDS, strict=True)], [*T.KEY, *(x for x, _ in T.IMAGES)])

    return T.over_tiles(tiles, radius, kernel, T.TILE_SCHEMA, size)


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.tiles(spark, d, SIZE)


def _one(name: str, margin: int, kernel, entire: bool = True) -> DataFrame:
    """A query: mean and largest value of a map over each scene."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = T.means(_tiles(spark, d), margin, lambda s: {"v": kernel(s)}, ["v"], SIZE, entire)
        return found.select("scene_id", F.round(F.col("v_sum") / F.col("n"), 6).alias("mean"), F.round("v_most", 6).alias("most"))

    run.__name__ = name
    return run


def _row_mean(a: np.ndarray, inside: np.ndarray, radius: int) -> np.ndarray:
    held = np.where(inside[:, None, :], a, 0.0)
    n = a.shape[2] - 2 * radius
    sums, counts = (sum(v[..., k : k + n] for k in range(2 * radius + 1)) for v in (held, inside[:, None, :].astype(np.int64)))
    return sums / counts


def _light_along_rows(s: T.Stack) -> np.ndarray:
    at = s.columns(7)
    inside = (at >= 0) & (at < s.w[:, None])
    u, v = (_row_mean(T.luma(s.near(t, 7)[:, 7 : t.shape[1] - 7 - 2 * (s.margin - 7)], SSIM_LUMA), inside, 7) for t in (s.t1, s.t2))
    return np.abs(u - v) / (u + v + 1e-4)


def _ssim(s: T.Stack) -> np.ndarray:
    return ssim_dissimilarity(T.luma(s.t1, SSIM_LUMA), T.luma(s.t2, SSIM_LUMA), mean=T.folded if s.entire else T.weighed)


def _several(found: DataFrame, key: str, names: dict[str, object], kind: str) -> DataFrame:
    """Rows (scene_id, ``key``, mean, most) of the maps ``names``."""
    rows = F.explode(F.array(*[F.struct(F.lit(v).cast(kind).alias(key), F.round(F.col(f"{n}_sum") / F.col("n"), 6).alias("mean"), F.round(f"{n}_most", 6).alias("most")) for n, v in names.items()]))
    return found.select("scene_id", rows.alias("r")).select("scene_id", "r.*")


def j8_blur(spark: SparkSession, d: str) -> DataFrame:
    """How far three blurs move the second image's luma."""
    names = {f"b{s}": s for s in BLUR}

    def maps(s: T.Stack) -> dict[str, np.ndarray]:
        v = T.luma(s.t2, LUMA)
        return {n: np.abs(s.near(v) - s.weighed(s.near(v, 4 * sigma), gaussian(sigma))) for n, sigma in names.items()}

    return _several(T.means(_tiles(spark, d), 16, maps, list(names), SIZE, True), "sigma", names, "int")


def j9_shift(spark: SparkSession, d: str) -> DataFrame:
    """Differences from the second image moved by three distances."""
    names = {f"m{k}": k for k in SHIFT}

    def maps(s: T.Stack) -> dict[str, np.ndarray]:
        u = T.luma(s.near(s.t1), LUMA)
        return {n: np.abs(u - moved(T.luma(s.t2, LUMA), k, 5)) for n, k in names.items()}

    found = T.means(_tiles(spark, d), 5, maps, list(names), SIZE)
    return _several(found, "shift", names, "int").join(found.select("scene_id", "n"), "scene_id").select("scene_id", "shift", "n", "mean")


def j10_shadow(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference with a shadow on the second image, at the usual place and by seed."""
    names = {f"{place}{i}": f"shadow_{place}_{share}" for i, share in enumerate(SHADOW) for place in ("fixed", "seeded")}

    def maps(s: T.Stack) -> dict[str, np.ndarray]:
        dark, light = pixel_diff(s.t1, darker(s.t2)), pixel_diff(s.t1, s.t2)
        return {n: np.where(in_shadow(s, 0, SHADOW[int(n[-1])], None if n.startswith("fixed") else SEED), dark, light) for n in names}

    return _several(T.means(_tiles(spark, d), 0, maps, list(names), SIZE), "cond", names, "string").drop("most")


def j4_ssim_channels(spark: SparkSession, d: str) -> DataFrame:
    """Structural dissimilarity of each channel, averaged."""
    return _one("j4", 5, lambda s: ssim_by_channel(s.t1, s.t2, T.folded if s.entire else T.weighed))(spark, d)


def j18_gated_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores gated by all signals at three strengths, with the margin and without; strength 0 leaves them as they are."""
    names = {f"g{i}{u}": (gamma, bool(u)) for i, gamma in enumerate((0.0, 0.3, 0.6)) for u in (0, 1)}

    def maps(s: T.Stack) -> dict[str, np.ndarray]:
        found = signals(s)
        q = defect(found, *WEIGHTS)
        return {n: gated(found["p"], gamma, found["margin"] if use else 1.0, q) for n, (gamma, use) in names.items()}

    found = T.means(_tiles(spark, d), 8, maps, list(names), SIZE, True)
    rows = [F.struct(F.lit(gamma).alias("gamma"), F.lit(use).alias("with_margin"), F.round(F.col(f"{n}_sum") / F.col("n"), 6).alias("mean"), F.round(f"{n}_most", 6).alias("most")) for n, (gamma, use) in names.items()]
    return found.select("scene_id", F.explode(F.array(*rows)).alias("r")).select("scene_id", "r.*")


def vari_map(image: np.ndarray) -> np.ndarray:
    """(g - r) / (g + r - b), 0 where the denominator is less than 1e-6 from 0, within [-1, 1]."""
    r, g, b = (image[..., c] / 255 for c in range(3))
    den = g + r - b
    small = np.abs(den) < 1e-6
    return np.where(small, 0, np.clip((g - r) / np.where(small, 1, den), -1, 1))


# fixed values: deviation of an image without any variance, and means of one that is dark or bright
FLAT, DARK, BRIGHT = 1e-4, 0.12, 0.88


def j19_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean vegetation index of both images of a scene, 0 for one without variance, and what is to be said of their light; shadow dims the second ones of every third scene."""

    def maps(s: T.Stack) -> dict[str, np.ndarray]:
        second = np.where((s.scene % 3 == 0)[:, None, None, None], s.t2 // 16, s.t2)
        out = {}
        for i, image in ((1, s.t1), (2, second)):
            level = image / 255
            out |= {f"v{i}": vari_map(image), f"l{i}": level.mean(axis=3), f"q{i}": (level**2).mean(axis=3)}
        return out

    found = T.means(_tiles(spark, d), 0, maps, [f"{c}{i}" for i in (1, 2) for c in "vlq"], SIZE)
    of = lambda c: F.col(f"{c}_sum") / F.col("n")
    out = [F.col("scene_id")]
    for i, side in ((1, "before"), (2, "after")):
        deviation = F.sqrt(F.greatest(F.lit(0.0), of(f"q{i}") - of(f"l{i}") * of(f"l{i}")))
        note = F.when(deviation < FLAT, "zero_variance").when(of(f"l{i}") < DARK, "dark").when(of(f"l{i}") > BRIGHT, "bright").otherwise("")
        out += [F.round(F.when(deviation < FLAT, 0.0).otherwise(of(f"v{i}")), 6).alias(f"vari_{side}"), F.round(of(f"l{i}"), 6).alias(f"level_{side}"), note.alias(f"note_{side}")]
    return found.select(*out)


def d25_gate_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    names = [*WEIGHTS, "margin"]
    found = T.means(_tiles(spark, d), 8, signals, names, SIZE, True)
    return found.select("scene_id", *[F.round(F.col(f"{n}_sum") / F.col("n"), 6).alias(n) for n in names])


def d11_gate_grid(spark: SparkSession, d: str) -> DataFrame:
    """The first best of the grid, in the order of gamma, then threshold."""
    grid = gate_grid(_tiles(spark, d), SIZE)
    return grid.orderBy(F.desc("f1"), "gamma", "tau").limit(1).select("gamma", "tau", "tp", "fp", "fn", "tn", "f1")


def d28_gamma_sweep(spark: SparkSession, d: str) -> DataFrame:
    return gate_grid(_tiles(spark, d), SIZE).where(F.abs(F.col("tau") - TAU) < 1e-5).select("gamma", "precision", "recall", "f1")


def d30_gating_ablation(spark: SparkSession, d: str) -> DataFrame:
    """The seven conditions, with gamma and threshold from the grid."""
    best = d11_gate_grid(spark, d).first()
    return gating_ablation(_tiles(spark, d), SIZE, best["gamma"], best["tau"]) if best else summed(spark.createDataFrame([], "cond string, tp long, fp long, fn long, tn long"), "cond")


def d20_robustness(spark: SparkSession, d: str) -> DataFrame:
    return robustness_matrix(_tiles(spark, d), SIZE)


def l1_morphology(spark: SparkSession, d: str) -> DataFrame:
    """Set pixels of each scene's mask after closing and opening."""
    found = T.means(_tiles(spark, d), 4, lambda s: {"m": morphology((pixel_diff(s.t1, s.t2) >= CUT).astype(np.uint8))}, ["m"], SIZE)
    return found.select("scene_id", F.col("m_sum").cast("long").alias("set_pixels"))


def m3_estimate_shift(spark: SparkSession, d: str, radius: int = 2) -> DataFrame:
    """Known shifts found again."""
    return estimate_shift(displaced(_tiles(spark, d), radius, SIZE), radius, SIZE)


def k2_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches of 24 pixels every 16, filled up with 7 beyond the scene."""
    found = T.extract_patches(_tiles(spark, d), 24, 16, True, 7)
    return found.select("scene_id", "patch", "y", "x", "is_padded", "changed", F.round("share", 6).alias("share"), F.md5(F.encode(F.hex("t2"), "UTF-8")).alias("t2_md5"))


def k3_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """Scenes put together again from patches of 16 pixels every 12, without those that would stick out."""
    whole = T.reconstruct(T.extract_patches(_tiles(spark, d), 16, 12, False), 12, False, SIZE)
    return whole.select("scene_id", "ty", "tx", F.md5(F.encode(F.hex("t2"), "UTF-8")).alias("t2_md5"))


def k4_tiles_to_pixels(spark: SparkSession, d: str) -> DataFrame:
    rows = T.tiles_to_pixels(_tiles(spark, d))
    place = F.col("y") * F.col("w") + F.col("x")
    return rows.groupBy("scene_id").agg(F.count("*").alias("n"), *[F.sum(F.col(c) * place).alias(c) for c in ("r1", "g1", "b1", "r2", "g2", "b2", "gt")])


def k5_pixels_to_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Pixels into tiles of another size."""
    made = T.pixels_to_tiles(T.tiles_to_pixels(_tiles(spark, d)), 20)
    return made.select("scene_id", "ty", "tx", F.length("label").alias("n"), F.md5(F.encode(F.concat(F.hex("t1"), F.hex("t2"), F.hex("label")), "UTF-8")).alias("md5"))


MAPS = {
    "j4_ssim_dissimilarity": (5, _ssim),
    "j13_registration_discrepancy": (8, lambda s: signals(s)["s_reg"]),
    "j14_illumination_box": (8, lambda s: signals(s)["s_illum"]),
    "j14_illumination_discrepancy": (7, _light_along_rows, False),
    "j15_sharpness_discrepancy": (8, lambda s: signals(s)["s_sharp"]),
    "j17_defect_index": (8, lambda s: defect(signals(s), *WEIGHTS)),
}
FUNCTIONS = (
    j4_ssim_channels, j8_blur, j9_shift, j10_shadow, j18_gated_scores, j19_evidence, d25_gate_diagnostics, d11_gate_grid, d28_gamma_sweep, d30_gating_ablation, d20_robustness,
    l1_morphology, m3_estimate_shift, k2_patches, k3_reconstruct, k4_tiles_to_pixels, k5_pixels_to_tiles,
)
QUERIES = {name: _one(name, *of) for name, of in MAPS.items()} | {f.__name__: f for f in FUNCTIONS}
SQL = tile_sql.SQL
