"""Scenes as tables of tiles: bytes of square blocks, windows around them, and kernels on whole arrays.

A tile row is (scene_id, ty, tx, size, h, w, t1, t2, label): the block at (ty * size, tx * size) of a
scene of h x w pixels, row by row, three bytes a pixel of both images and one of the label. An
operator that looks beyond its tile gets the borders it needs from the neighbours in one shuffle; scenes of
a single tile need none, and those of up to WHOLE pixels a side are put together by scene. Beyond the scene, borders are reflected (d c b a | a b c d | d c b a).
Tiles of like shape are stacked, so that a kernel runs over many small ones at once.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of a stack, with borders.
STACK_PIXELS = 1 << 17
#: Scenes of so many pixels a side, or fewer, are taken as a whole.
WHOLE = 128
KEY = ["scene_id", "ty", "tx", "size", "h", "w"]
IMAGES = (("t1", 3), ("t2", 3), ("label", 1))
PIECE_SCHEMA = "scene_id long, ty int, tx int, size int, h int, w int, py int, px int, ph int, pw int, t1 binary, t2 binary, label binary"
PIECE_NAMES = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
PIECE_KINDS = [pa.int64(), *[pa.int32()] * 9, *[pa.binary()] * 3]
TILE_SCHEMA = "scene_id long, ty int, tx int, size int, h int, w int, t1 binary, t2 binary, label binary"
TILE_KINDS = [pa.int64(), *[pa.int32()] * 5, *[pa.binary()] * 3]
PIXEL_SCHEMA = "scene_id long, h int, w int, y int, x int, r1 int, g1 int, b1 int, r2 int, g2 int, b2 int, gt int"
PATCH_SCHEMA = "scene_id long, patch int, y int, x int, size int, h int, w int, is_padded boolean, changed long, share double, t1 binary, t2 binary, label binary"
PATCH_NAMES = [x.split()[0] for x in PATCH_SCHEMA.split(", ")]
PATCH_FIELDS = pa.schema(list(zip(PATCH_NAMES, [pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.int64(), pa.float64(), *[pa.binary()] * 3], strict=True)))


@dataclass
class Stack:
    """Tiles of like shape: images of (n, rows, columns, 3) with ``margin`` pixels around the tile, labels without.

    If they are ``entire`` scenes, there is no margin, whatever was asked for: what is beyond them is known.
    """

    scene: np.ndarray
    ty: np.ndarray
    tx: np.ndarray
    y0: np.ndarray
    x0: np.ndarray
    h: np.ndarray
    w: np.ndarray
    margin: int
    t1: np.ndarray
    t2: np.ndarray
    label: np.ndarray
    entire: bool = False

    def near(self, image: np.ndarray, margin: int = 0) -> np.ndarray:
        """The part of an image, or of a map as large, with only ``margin`` pixels around the tile."""
        cut = 0 if self.entire else self.margin - margin
        return image[:, cut : image.shape[1] - cut, cut : image.shape[2] - cut]

    def out(self, margin: int) -> int:
        """The margin there is where ``margin`` is wanted."""
        return 0 if self.entire else margin

    def bordered(self, a: np.ndarray, margin: int) -> np.ndarray:
        """``a`` of entire scenes with ``margin`` pixels around; ``a`` of other tiles has them already."""
        if not self.entire:
            return a
        rows, cols = (reflected(-margin, side + margin, side) for side in a.shape[1:3])
        return a[:, rows][:, :, cols]

    def weighed(self, a: np.ndarray, weights: list[float]) -> np.ndarray:
        """As ``weighed``, which takes the weights' reach off, unless scenes are entire."""
        return (folded if self.entire else weighed)(a, weights)

    def rows(self, margin: int = 0) -> np.ndarray:
        """Where the pixels of each tile's rows stand in the scene, those around it as if the scene went on."""
        return self.y0[:, None] + np.arange(-margin, self.label.shape[1] + margin)

    def columns(self, margin: int = 0) -> np.ndarray:
        return self.x0[:, None] + np.arange(-margin, self.label.shape[2] + margin)


@dataclass
class Windows:
    """Along a side: window k spans k * stride - margin to k * stride + size + margin; as many as ``count`` says of a side."""

    size: int
    stride: int
    margin: int
    count: Callable[[int], int]

    def span(self, k: int) -> tuple[int, int]:
        return k * self.stride - self.margin, k * self.stride + self.size + self.margin

    def meeting(self, first: int, end: int, side: int) -> list[int]:
        """The windows that hold any of the pixels from ``first`` to ``end``."""
        low = max(0, (first - self.size - self.margin) // self.stride)
        return [k for k in range(low, min(self.count(side), (end + self.margin - 1) // self.stride + 1)) if self.span(k)[1] > first and self.span(k)[0] < end]


def tiled(size: int, margin: int) -> Windows:
    return Windows(size, size, margin, lambda side: -(-side // size))


def patches(size: int, stride: int, pad: bool) -> Windows:
    """Patches from the start of a side on; those that don't fit are left out, or with ``pad`` filled up."""

    def count(side: int) -> int:
        over = side - size
        return (1 if pad else 0) if over < 0 else (-(-over // stride) if pad else over // stride) + 1

    return Windows(size, stride, 0, count)


def reflected(first: int, end: int, side: int) -> np.ndarray:
    at = np.arange(first, end) % (2 * side)
    return np.where(at < side, at, 2 * side - 1 - at)


def _arrays(batch: pa.RecordBatch, i: int, h: int, w: int) -> list[np.ndarray]:
    out = []
    for name, depth in IMAGES:
        data = batch[name][i].as_buffer() if batch[name][i].is_valid else b""
        if len(data) != h * w * depth:
            raise ValueError(f"{name} of scene {batch['scene_id'][i]} has {len(data)} bytes for {h} x {w} pixels")
        out.append(np.frombuffer(data, np.uint8).reshape(h, w, depth))
    return out


def _images(data: pa.Array, n: int, h: int, w: int, depth: int, name: str, scene: pa.Array) -> np.ndarray:
    """``n`` images of h x w pixels from their bytes, (n, h, w, channels)."""
    wrong = pc.fill_null(pc.not_equal(pc.binary_length(data), h * w * depth), True).to_numpy(zero_copy_only=False)
    if wrong.any():
        raise ValueError(f"{name} of scene {scene[int(wrong.argmax())]} has not the bytes for {h} x {w} pixels")
    offsets = np.frombuffer(data.buffers()[1], np.int32, n + 1, 4 * data.offset)
    return np.frombuffer(data.buffers()[2], np.uint8, n * h * w * depth, int(offsets[0])).reshape(n, h, w, depth) if n else np.zeros((0, h, w, depth), np.uint8)


def _many(batch: pa.RecordBatch, h: int, w: int) -> list[np.ndarray]:
    """The images of tiles that are all of h x w pixels, (n, h, w, channels)."""
    return [_images(batch[name], batch.num_rows, h, w, depth, name, batch["scene_id"]) for name, depth in IMAGES]


def _binary(a: np.ndarray) -> pa.Array:
    """The bytes of each of ``a`` (n, ...)."""
    a = np.ascontiguousarray(a)
    ends = np.arange(len(a) + 1, dtype=np.int32) * (a.size // max(1, len(a)))
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(a)])


def _alike(batch: pa.RecordBatch, keys: list[str], pixels: Callable[..., int]) -> Iterator[tuple[list[int], pa.RecordBatch]]:
    """Rows with equal ``keys``, as many at a time as a stack holds; ``pixels`` of one of them."""
    if batch.num_rows:
        found, which = np.unique(np.stack([batch[c].to_numpy() for c in keys]), axis=1, return_inverse=True)
        for k, key in enumerate(found.T.tolist()):
            like = np.flatnonzero(which.ravel() == k)
            some = max(1, STACK_PIXELS // max(1, pixels(*key)))
            for i in range(0, len(like), some):
                yield key, batch.take(pa.array(like[i : i + some]))


def _scenes(batches: Iterator[pa.RecordBatch], margin: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(scene_id, images) of like scenes, from tiles that are scenes or from rows of ``by_whole``."""
    for batch in batches:
        area = lambda size, h, w: (h + 2 * margin) * (w + 2 * margin)
        for (size, h, w), part in _alike(batch, ["size", "h", "w"], area):
            scene = part["scene_id"].to_numpy()
            if "tiles" not in part.schema.names:
                yield scene, _many(part, h, w)
                continue
            flat, counts = part["tiles"].flatten(), pc.list_value_length(part["tiles"]).to_numpy()
            of = np.repeat(np.arange(len(scene)), counts)
            at = {c: flat.field(c).to_numpy() for c in ("ty", "tx")}
            places = [(ty, tx) for ty in range(-(-h // size)) for tx in range(-(-w // size))]
            order = np.lexsort((at["tx"], at["ty"], of))
            found = Counter(zip(of.tolist(), at["ty"].tolist(), at["tx"].tolist(), strict=True))
            if wrong := [(i, *k) for i in range(len(scene)) for k in places if found.pop((i, *k), 0) != 1] or list(found):
                i, ty, tx = wrong[0]
                raise ValueError(f"scene {scene[i]}: the pixels of or around tile {ty}, {tx} aren't there once")
            images = [np.empty((len(scene), h, w, depth), np.uint8) for _, depth in IMAGES]
            for k, (ty, tx) in enumerate(places):
                rows = pa.array(order[k :: len(places)])
                y, x = slice(ty * size, min(h, (ty + 1) * size)), slice(tx * size, min(w, (tx + 1) * size))
                for to, (name, depth) in zip(images, IMAGES, strict=True):
                    to[:, y, x] = _images(flat.field(name).take(rows), len(scene), y.stop - y.start, x.stop - x.start, depth, name, part["scene_id"])
            yield scene, images


def by_whole(tiles: DataFrame) -> DataFrame:
    """Scenes with their tiles, for scenes of at most WHOLE pixels a side; each tile travels once, without borders."""
    return tiles.groupBy("scene_id", "size", "h", "w").agg(F.collect_list(F.struct("ty", "tx", *(x for x, _ in IMAGES))).alias("tiles"))


def _by_extent(tiles: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Inputs of ``_scenes``, and the tiles of larger scenes."""
    alone = (F.col("h") <= F.col("size")) & (F.col("w") <= F.col("size"))
    small = (F.col("h") <= WHOLE) & (F.col("w") <= WHOLE)
    return [tiles.where(alone), by_whole(tiles.where(~alone & small))], tiles.where(~alone & ~small)


def _stacks(rows: list[tuple], margin: int) -> Iterator[Stack]:
    """``rows``: (scene_id, ty, tx, y0, x0, h, w, t1, t2, label), all of a shape."""
    pixels = rows[0][7].shape[0] * rows[0][7].shape[1]
    some = max(1, STACK_PIXELS // max(1, pixels))
    for i in range(0, len(rows), some):
        *head, t1, t2, label = zip(*rows[i : i + some], strict=True)
        yield Stack(*map(np.array, head), margin, np.stack(t1), np.stack(t2), np.stack(label)[..., 0])


def _framed(key: tuple, block: list[np.ndarray], at: tuple[int, int], span: tuple[tuple[int, int], tuple[int, int]], margin: int) -> tuple:
    """A row for ``_stacks``: ``block`` holds the pixels of the scene from ``at`` on that ``span`` meets."""
    scene, ty, tx, h, w = key
    (y0, y1), (x0, x1) = span
    rows = reflected(y0, min(y1 - margin, h) + margin, h) - at[0]
    cols = reflected(x0, min(x1 - margin, w) + margin, w) - at[1]
    t1, t2, label = (a[rows][:, cols] for a in block)
    return scene, ty, tx, y0 + margin, x0 + margin, h, w, t1, t2, label[margin : len(rows) - margin, margin : len(cols) - margin]


def _whole(margin: int, kernel: Callable[[Stack], pa.RecordBatch], entire: bool = False):
    """For scenes as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scene, (t1, t2, label) in _scenes(batches, margin):
            n, h, w = label.shape[:3]
            if entire:
                zero = np.zeros(n, np.int64)
                yield kernel(Stack(scene, zero, zero, zero, zero, np.full(n, h), np.full(n, w), 0, t1, t2, label[..., 0], True))
                continue
            rows, cols = (reflected(-margin, side + margin, side) for side in (h, w))
            zero = np.zeros(n, np.int64)
            yield kernel(Stack(scene, zero, zero, zero, zero, np.full(n, h), np.full(n, w), margin, t1[:, rows][:, :, cols], t2[:, rows][:, :, cols], label[..., 0]))

    return run


def _as_they_are(batches: Iterator[pa.RecordBatch]) -> Iterator[Stack]:
    """Stacks of tiles without any margin; those of a stack have one place, and scenes of one size."""
    for batch in batches:
        side = lambda t, size, of: min(of, (t + 1) * size) - t * size
        for (ty, tx, size, h, w), part in _alike(batch, KEY[1:], lambda ty, tx, size, h, w: side(ty, size, h) * side(tx, size, w)):
            t1, t2, label = _many(part, side(ty, size, h), side(tx, size, w))
            place = [np.full(part.num_rows, v) for v in (ty, tx, ty * size, tx * size, h, w)]
            yield Stack(part["scene_id"].to_numpy(), *place, 0, t1, t2, label[..., 0])


def _pieces(windows: Windows):
    """What each window needs of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (scene, ty, tx, size, h, w) in enumerate(zip(*(batch[c].to_pylist() for c in KEY), strict=True)):
                y0, x0 = ty * size, tx * size
                y1, x1 = min(h, y0 + size), min(w, x0 + size)
                images = _arrays(batch, i, y1 - y0, x1 - x0)
                for ky in windows.meeting(y0, y1, h):
                    a, b = (max(windows.span(ky)[0], y0), min(windows.span(ky)[1], y1))
                    for kx in windows.meeting(x0, x1, w):
                        c, d = (max(windows.span(kx)[0], x0), min(windows.span(kx)[1], x1))
                        out.append((scene, ky, kx, size, h, w, a, c, b - a, d - c, *(np.ascontiguousarray(m[a - y0 : b - y0, c - x0 : d - x0]).tobytes() for m in images)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), PIECE_KINDS, strict=True)], PIECE_NAMES)

    return run


def _groups(batches: Iterator[pa.RecordBatch], with_size: bool = False) -> Iterator[tuple]:
    """Windows (scene_id, ty, tx, h, w) with their pieces (y, x, images), which come one after the other, and the pieces' size."""
    now, pieces, size = None, [], 0
    for batch in batches:
        for i, (scene, ty, tx, h, w, py, px, ph, pw) in enumerate(zip(*(batch[c].to_pylist() for c in ("scene_id", "ty", "tx", "h", "w", "py", "px", "ph", "pw")), strict=True)):
            if (scene, ty, tx, h, w) != now:
                if pieces:
                    yield (now, pieces, size) if with_size else (now, pieces)
                now, pieces, size = (scene, ty, tx, h, w), [], batch["size"][i].as_py()
            pieces.append((py, px, _arrays(batch, i, ph, pw)))
    if pieces:
        yield (now, pieces, size) if with_size else (now, pieces)


def _joined(key: tuple, pieces: list, windows: Windows) -> tuple[list[np.ndarray], tuple[int, int], tuple]:
    """The pixels of a window within its scene, where they begin, and the window's span."""
    scene, ty, tx, h, w = key
    span = windows.span(ty), windows.span(tx)
    at = max(0, span[0][0]), max(0, span[1][0])
    shape = min(h, span[0][1]) - at[0], min(w, span[1][1]) - at[1]
    block = [np.zeros((*shape, depth), np.uint8) for _, depth in IMAGES]
    there = 0
    for py, px, images in pieces:
        there += images[0].shape[0] * images[0].shape[1]
        for whole, image in zip(block, images, strict=True):
            whole[py - at[0] : py - at[0] + image.shape[0], px - at[1] : px - at[1] + image.shape[1]] = image
    if there != shape[0] * shape[1]:
        raise ValueError(f"scene {scene}: {there} of the {shape[0] * shape[1]} pixels around tile {ty}, {tx} are there")
    return block, at, span


def _assembled(windows: Windows, kernel: Callable[[Stack], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like: dict[tuple[int, int], list[tuple]] = {}
        held = 0
        for key, pieces in _groups(batches):
            row = _framed(key, *_joined(key, pieces, windows), windows.margin)
            like.setdefault(row[7].shape[:2], []).append(row)
            held += row[7].shape[0] * row[7].shape[1]
            if held >= STACK_PIXELS:
                for rows in like.values():
                    yield from map(kernel, _stacks(rows, windows.margin))
                like, held = {}, 0
        for rows in like.values():
            yield from map(kernel, _stacks(rows, windows.margin))

    return run


def gathered(tiles: DataFrame, windows: Windows) -> DataFrame:
    """Pieces of tiles by the window that needs them, those of a window together; the one shuffle of an operator on tiles."""
    by = ["scene_id", "ty", "tx"]
    return tiles.mapInArrow(_pieces(windows), PIECE_SCHEMA).repartition(*by).sortWithinPartitions(*by)


def over_tiles(tiles: DataFrame, margin: int, kernel: Callable[[Stack], pa.RecordBatch], schema: str, size: int, entire: bool = False) -> DataFrame:
    """``kernel`` over all ``tiles`` of ``size``, each with ``margin`` pixels of its neighbours around it.

    With ``entire``, the kernel can take entire scenes without a margin, as those of up to WHOLE pixels a side.
    A tile of a size that its bytes don't have, and a neighbour that isn't there, are errors.
    """
    if not margin:
        return tiles.mapInArrow(lambda batches: map(kernel, _as_they_are(batches)), schema)
    scenes, large = _by_extent(tiles)
    windows = tiled(size, margin)
    found = gathered(large, windows).mapInArrow(_assembled(windows, kernel), schema)
    for some in scenes:
        found = found.unionByName(some.mapInArrow(_whole(0 if entire else margin, kernel, entire), schema))
    return found


def extract_patches(tiles: DataFrame, size: int, stride: int, pad: bool, pad_value: int = 0) -> DataFrame:
    """Patches of ``size`` every ``stride`` pixels, numbered by rows, as bytes; what sticks out of a scene is ``pad_value``, in labels 0.

    Returns (scene_id, patch, y, x, size, h, w, is_padded, changed, share, t1, t2, label); ``share`` is of
    the whole patch.
    """
    windows = patches(size, stride, pad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pieces in _groups(batches):
            scene, ky, kx, h, w = key
            block, (y, x), _ = _joined(key, pieces, windows)
            whole = [np.full((size, size, depth), pad_value if name != "label" else 0, np.uint8) for name, depth in IMAGES]
            for to, of in zip(whole, block, strict=True):
                to[: of.shape[0], : of.shape[1]] = of
            changed = int((whole[2] > 0).sum())
            row = (scene, ky * windows.count(w) + kx, y, x, size, h, w, block[0].shape[:2] != (size, size), changed, changed / size**2, *(a.tobytes() for a in whole))
            yield pa.RecordBatch.from_pylist([dict(zip(PATCH_NAMES, row, strict=True))], PATCH_FIELDS)

    def of_scenes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scene, images in _scenes(batches, 0):
            n, h, w = images[0].shape[:3]
            for ky in range(windows.count(h)):
                for kx in range(windows.count(w)):
                    y, x = ky * stride, kx * stride
                    block = [a[:, y : y + size, x : x + size] for a in images]
                    padded = block[0].shape[1:3] != (size, size)
                    if padded:
                        whole = [np.full((n, size, size, depth), pad_value if name != "label" else 0, np.uint8) for name, depth in IMAGES]
                        for to, of in zip(whole, block, strict=True):
                            to[:, : of.shape[1], : of.shape[2]] = of
                        block = whole
                    changed = (block[2] > 0).reshape(n, -1).sum(axis=1)
                    place = [np.full(n, v, np.int32) for v in (ky * windows.count(w) + kx, y, x, size, h, w)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (scene, *place, np.full(n, padded), changed, changed / size**2)] + [_binary(a) for a in block], schema=PATCH_FIELDS)

    scenes, large = _by_extent(tiles)
    found = gathered(large, windows).mapInArrow(run, PATCH_SCHEMA)
    for some in scenes:
        found = found.unionByName(some.mapInArrow(of_scenes, PATCH_SCHEMA))
    return found


def reconstruct(found: DataFrame, stride: int, pad: bool, size: int) -> DataFrame:
    """Tiles of ``size`` from patches (scene_id, patch, y, x, size, h, w, t1, t2, label): pixels that several cover are means, half to even.

    What no patch covers, at the right and below, repeats the last column and then the last row that is covered. A
    patch that isn't there is an error.
    """

    def reach(grid: Windows, side: int) -> int:
        return min(side, grid.span(grid.count(side) - 1)[1])

    def span(k: int, end: int, side: int) -> tuple[int, int]:
        return min(k * size, end - 1), min((k + 1) * size, side, end)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (scene, patch, y, x, p, h, w) in enumerate(zip(*(batch[c].to_pylist() for c in ("scene_id", "patch", "y", "x", "size", "h", "w")), strict=True)):
                images, grid = _arrays(batch, i, p, p), patches(p, stride, pad)
                bottom, right = reach(grid, h), reach(grid, w)
                for ty in range(-(-h // size)):
                    a, b = span(ty, bottom, h)
                    a, b = max(a, y), min(b, y + p)
                    for tx in range(-(-w // size)) if a < b else ():
                        c, d = span(tx, right, w)
                        c, d = max(c, x), min(d, x + p)
                        if c < d:
                            out.append((scene, ty, tx, p, h, w, a, c, b - a, d - c, *(np.ascontiguousarray(m[a - y : b - y, c - x : d - x]).tobytes() for m in images)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), PIECE_KINDS, strict=True)], PIECE_NAMES)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (scene, ty, tx, h, w), pieces, p in _groups(batches, with_size=True):
            grid = patches(p, stride, pad)
            (a, b), (c, d) = span(ty, reach(grid, h), h), span(tx, reach(grid, w), w)
            wanted = len(grid.meeting(a, b, h)) * len(grid.meeting(c, d, w))
            if len(pieces) != wanted:
                raise ValueError(f"scene {scene}: {len(pieces)} of {wanted} patches over tile {ty}, {tx} are there")
            sums, n = [np.zeros((b - a, d - c, depth), np.int64) for _, depth in IMAGES], np.zeros((b - a, d - c, 1), np.int64)
            for py, px, images in pieces:
                at = slice(py - a, py - a + images[0].shape[0]), slice(px - c, px - c + images[0].shape[1])
                n[at] += 1
                for to, of in zip(sums, images, strict=True):
                    to[at] += of
            rows = np.minimum(np.arange(ty * size, min(h, (ty + 1) * size)), b - 1) - a
            cols = np.minimum(np.arange(tx * size, min(w, (tx + 1) * size)), d - 1) - c
            whole = [np.rint(s / n).astype(np.uint8)[rows][:, cols].tobytes() for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((scene, ty, tx, size, h, w, *whole), TILE_KINDS, strict=True)], [*KEY, *(x for x, _ in IMAGES)])

    def of_scenes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (p, h, w), part in _alike(batch, ["size", "h", "w"], lambda p, h, w: h * w):
                grid, scene = patches(p, stride, pad), part["scene_id"].to_numpy()
                flat, counts = part["patches"].flatten(), pc.list_value_length(part["patches"]).to_numpy()
                places = [(ky * stride, kx * stride) for ky in range(grid.count(h)) for kx in range(grid.count(w))]
                of, at = np.repeat(np.arange(len(scene)), counts), [flat.field(c).to_numpy() for c in "yx"]
                order = np.lexsort((at[1], at[0], of))
                there = Counter(zip(of.tolist(), *(v.tolist() for v in at), strict=True))
                if wrong := [i for i in range(len(scene)) if counts[i] != len(places) or any(there[i, *k] != 1 for k in places)]:
                    raise ValueError(f"scene {scene[wrong[0]]}: {counts[wrong[0]]} of {len(places)} patches over tiles are there")
                bottom, right = reach(grid, h), reach(grid, w)
                sums, n = [np.zeros((len(scene), bottom, right, depth), np.int32) for _, depth in IMAGES], np.zeros((bottom, right, 1), np.int32)
                for k, (y, x) in enumerate(places):
                    rows, b, d = pa.array(order[k :: len(places)]), min(bottom, y + p), min(right, x + p)
                    n[y:b, x:d] += 1
                    for to, (name, depth) in zip(sums, IMAGES, strict=True):
                        to[:, y:b, x:d] += _images(flat.field(name).take(rows), len(scene), p, p, depth, name, part["scene_id"])[:, : b - y, : d - x]
                means = [np.rint(s / n).astype(np.uint8) for s in sums]
                for ty in range(-(-h // size)):
                    for tx in range(-(-w // size)):
                        rows, cols = (np.minimum(np.arange(t * size, min(side, (t + 1) * size)), end - 1) for t, side, end in ((ty, h, bottom), (tx, w, right)))
                        place = [pa.array(np.full(len(scene), v, np.int32)) for v in (ty, tx, size, h, w)]
                        yield pa.RecordBatch.from_arrays([part["scene_id"], *place, *(_binary(m[:, rows][:, :, cols]) for m in means)], [*KEY, *(x for x, _ in IMAGES)])

    by, small = ["scene_id", "ty", "tx"], (F.col("h") <= WHOLE) & (F.col("w") <= WHOLE)
    large = found.where(~small).mapInArrow(dealt, PIECE_SCHEMA).repartition(*by).sortWithinPartitions(*by).mapInArrow(joined, TILE_SCHEMA)
    scenes = found.where(small).groupBy("scene_id", "size", "h", "w").agg(F.collect_list(F.struct("y", "x", *(x for x, _ in IMAGES))).alias("patches"))
    return large.unionByName(scenes.mapInArrow(of_scenes, TILE_SCHEMA))


def tiles_to_pixels(tiles: DataFrame) -> DataFrame:
    """(scene_id, h, w, y, x, r1, g1, b1, r2, g2, b2, gt), a row a pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _as_they_are(batches):
            shape = t.label.shape
            columns = [t.scene[:, None, None], *(v.astype(np.int32)[:, None, None] for v in (t.h, t.w)), t.rows().astype(np.int32)[:, :, None], t.columns().astype(np.int32)[:, None, :]]
            columns += [a[..., c].astype(np.int32) for a in (t.t1, t.t2) for c in range(3)] + [t.label.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(c, shape).ravel()) for c in columns], [x.split()[0] for x in PIXEL_SCHEMA.split(", ")])

    return tiles.mapInArrow(run, PIXEL_SCHEMA)


def _parts(size: int):
    """Pixels of a batch by tile: (scene_id, ty, tx, h, w, at, bytes), places within the tile and seven bytes a pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scene, h, w, y, x = (batch[c].to_numpy() for c in ("scene_id", "h", "w", "y", "x"))
            ty, tx = y // size, x // size
            values = np.stack([batch[c].to_numpy() for c in ("r1", "g1", "b1", "r2", "g2", "b2", "gt")], axis=1)
            bad = ~((values >= 0) & (values <= 255)).all(axis=1)
            if bad.any():
                i = int(bad.argmax())
                raise ValueError(f"scene {scene[i]}: values of tile {ty[i]}, {tx[i]} are no bytes")
            order = np.lexsort((tx, ty, scene))
            keys = [v[order] for v in (scene, ty, tx, h, w)]
            first = np.flatnonzero(np.concatenate(([True], np.any([np.diff(k) != 0 for k in keys], axis=0))))
            ends = np.append(first, len(order))
            at = np.ascontiguousarray(((y % size) * size + x % size).astype(np.int32)[order])
            data = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * n).astype(np.int32)), pa.py_buffer(v)]) for v, n in ((at, 4), (np.ascontiguousarray(values.astype(np.uint8)[order]), 7))]
            yield pa.RecordBatch.from_arrays([pa.array(k[first], t) for k, t in zip(keys, [pa.int64(), *[pa.int32()] * 4], strict=True)] + data, ["scene_id", "ty", "tx", "h", "w", "at", "bytes"])

    return run


def pixels_to_tiles(pixels: DataFrame, size: int) -> DataFrame:
    """Tiles of ``size`` from the columns of ``tiles_to_pixels``; values have to be 0 to 255 and each pixel there once, else it is an error.

    Pixels travel as the bytes of those that a batch holds of a tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = lambda t, of: max(0, min(of, (t + 1) * size) - t * size)
            for (ty, tx, h, w), part in _alike(batch, ["ty", "tx", "h", "w"], lambda ty, tx, h, w: side(ty, h) * side(tx, w)):
                scene, (high, wide) = part["scene_id"], (side(ty, h), side(tx, w))
                wanted = (np.arange(high)[:, None] * size + np.arange(wide)).ravel()
                at, values = [], []
                for i, (places, data) in enumerate(zip(part["at"].to_pylist(), part["bytes"].to_pylist(), strict=True)):
                    place = np.frombuffer(b"".join(places), np.int32)
                    order = np.argsort(place, kind="stable")
                    if not np.array_equal(place[order], wanted):
                        raise ValueError(f"scene {scene[i]}: the pixels of tile {ty}, {tx} aren't those of its place")
                    values.append(np.frombuffer(b"".join(data), np.uint8).reshape(-1, 7)[order])
                values = np.stack(values)
                place = [pa.array(np.full(part.num_rows, v, np.int32)) for v in (ty, tx, size, h, w)]
                yield pa.RecordBatch.from_arrays([scene, *place, *(_binary(values[..., a:b]) for a, b in ((0, 3), (3, 6), (6, 7)))], [*KEY, *(x for x, _ in IMAGES)])

    parts = pixels.mapInArrow(_parts(size), "scene_id long, ty int, tx int, h int, w int, at binary, bytes binary")
    lists = parts.groupBy("scene_id", "ty", "tx").agg(F.first("h").alias("h"), F.first("w").alias("w"), F.collect_list(F.struct("at", "bytes")).alias("parts"))
    return lists.select("scene_id", "ty", "tx", "h", "w", F.col("parts.at").alias("at"), F.col("parts.bytes").alias("bytes")).mapInArrow(run, TILE_SCHEMA)


def means(tiles: DataFrame, margin: int, maps: Callable[[Stack], dict[str, np.ndarray]], names: list[str], size: int, entire: bool = False) -> DataFrame:
    """(scene_id, n, ``name``_sum, ``name``_most): sums and largest values of maps over scenes; partial ones a tile meet in one shuffle."""

    def kernel(s: Stack) -> pa.RecordBatch:
        found = maps(s)
        columns = {"scene_id": s.scene, "n": np.full(len(s.scene), s.label[0].size)}
        for name in names:
            flat = found[name].reshape(len(s.scene), -1)
            columns |= {f"{name}_sum": flat.sum(axis=1, dtype=np.float64), f"{name}_most": flat.max(axis=1).astype(np.float64)}
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    schema = "scene_id long, n long, " + ", ".join(f"{x}_sum double, {x}_most double" for x in names)
    sums = [e for x in names for e in (F.sum(f"{x}_sum").alias(f"{x}_sum"), F.max(f"{x}_most").alias(f"{x}_most"))]
    return over_tiles(tiles, margin, kernel, schema, size, entire).groupBy("scene_id").agg(F.sum("n").alias("n"), *sums)


# kernels: arrays of (n, rows, columns); each takes off the border that it needs


def luma(image: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
    return (image.reshape(-1, 3).astype(np.float64) @ np.array(weights) / 255).reshape(image.shape[:-1])


def _along(a: np.ndarray, axis: int, first: int, n: int) -> np.ndarray:
    return a[:, first : first + n] if axis == 1 else a[:, :, first : first + n]


def box_mean(a: np.ndarray, radius: int) -> np.ndarray:
    width = 2 * radius + 1
    for axis in (1, 2):
        sums = np.cumsum(a, axis=axis)
        n = a.shape[axis] - width + 1
        first = np.concatenate((np.zeros_like(_along(sums, axis, 0, 1)), _along(sums, axis, 0, n - 1)), axis=axis)
        a = (_along(sums, axis, width - 1, n) - first) / width
    return a


@functools.lru_cache(256)
def _bands(side: int, weights: tuple[float, ...], fold: bool) -> np.ndarray:
    """The matrix that weighs a row of ``side`` pixels; with ``fold``, one that goes on in reflections."""
    taps, more = np.array([*weights[:0:-1], *weights]), 2 * (len(weights) - 1)
    out = np.zeros((side, side + more) if fold else (side - more, side))
    for k, w in enumerate(taps):
        np.fill_diagonal(out[:, k:], w)
    return out @ np.eye(side)[reflected(-more // 2, side + more // 2, side)] if fold else out


def weighed(a: np.ndarray, weights: list[float], fold: bool = False) -> np.ndarray:
    """Weighted sum along both sides; ``weights`` are those at distances 0, 1, ..."""
    high, wide = (_bands(side, tuple(weights), fold) for side in a.shape[1:])
    return high @ (a.reshape(-1, a.shape[2]) @ wide.T).reshape(len(a), a.shape[1], -1)


def folded(a: np.ndarray, weights: list[float]) -> np.ndarray:
    """As ``weighed``, over entire scenes, which go on in reflections."""
    return weighed(a, weights, True)


def extreme(a: np.ndarray, radius: int, f: np.ufunc) -> np.ndarray:
    for axis in (1, 2):
        n = a.shape[axis] - 2 * radius
        out = _along(a, axis, 0, n)
        for k in range(1, 2 * radius + 1):
            out = f(out, _along(a, axis, k, n))
        a = out
    return a


def sobel(a: np.ndarray) -> np.ndarray:
    dx, sx = a[:, :, 2:] - a[:, :, :-2], a[:, :, :-2] + 2 * a[:, :, 1:-1] + a[:, :, 2:]
    return np.hypot(dx[:, :-2] + 2 * dx[:, 1:-1] + dx[:, 2:], sx[:, 2:] - sx[:, :-2])


def laplacian(a: np.ndarray) -> np.ndarray:
    return a[:, 1:-1, :-2] + a[:, 1:-1, 2:] + a[:, :-2, 1:-1] + a[:, 2:, 1:-1] - 4 * a[:, 1:-1, 1:-1]
