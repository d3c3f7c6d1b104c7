"""Inputs of the queries, derived from the given tables in either engine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS image_id", "turn AS caption_idx", "text", "concat('cat_', conv_id % 10) AS category")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a scored item and model."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 128 AS scene_id", "(l_quantity - 1) / 49 AS a", "round(l_discount * 10, 2) AS b", "cast(l_returnflag = 'R' AS int) AS gt")
    return rows.selectExpr("scene_id", "gt", "stack(2, 'a', a, 'b', b) AS (model, score)")


#: Pixels along each side of a scene; odd, so that no mean over a scene falls halfway between two decimals.
SIDE = 17
PIXELS = """
SELECT s AS scene_id, y, x, (31*s+13*x+17*y) % 256 AS r1, (17*s+29*x+7*y) % 256 AS g1, (11*s+5*x+23*y) % 256 AS b1,
       (x >= s % 10 AND x < s % 10 + 3 + s % 4 AND y >= s*7 % 10 AND y < s*7 % 10 + 3 + {third} % 4) AS hit
FROM {grid}
"""


#: Scenes that a task makes.
SCENES_A_TASK = 1000


def by_scene(scenes: DataFrame) -> DataFrame:
    """``scenes`` (scene_id, ...) dealt by scene before they grow into pixels, so that what is grouped by scene needs no other shuffle and no task makes more than a bounded number."""
    n = max(2 * scenes.sparkSession.sparkContext.defaultParallelism, -(-scenes.count() // SCENES_A_TASK))
    return scenes.repartition(n, "scene_id")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of small scenes for every part: outside a box the second differs by 0 to 4, inside it is inverted."""
    parts = by_scene(table(spark, sf_dir, "part").selectExpr("p_partkey AS scene_id"))
    line = f"explode(sequence(0, {SIDE - 1}))"
    grid = parts.selectExpr("scene_id AS s", f"{line} AS y").selectExpr("s", "y", f"{line} AS x")
    rows = spark.sql(PIXELS.format(third="cast(floor(s / 3) AS bigint)", grid="{grid}"), grid=grid)
    second = [f"CASE WHEN hit THEN 255 - {c}1 ELSE least(255, {c}1 + (scene_id + x + y) % 5) END AS {c}2" for c in "rgb"]
    return rows.selectExpr("scene_id", "y", "x", "r1", "g1", "b1", *second, "cast(hit AS int) AS gt")


#: Sides of the scenes of tiles: most are small, every 32nd is 61 x 61 and every other 32nd 47 x 61, with boxes four times as large.
HEIGHT = "CASE s % 32 WHEN 0 THEN 61 WHEN 16 THEN 47 ELSE 17 END"
WIDTH = "CASE s % 16 WHEN 0 THEN 61 ELSE 17 END"
SCALE = "CASE s % 16 WHEN 0 THEN 4 ELSE 1 END"


def _drawn(scene_id: pa.Array, ty: pa.Array, tx: pa.Array, size: pa.Array, h: pa.Array, w: pa.Array, k: pa.Array) -> pa.Array:
    """Bytes of the tiles of scenes, row by row: red, green and blue of both images, and whether a pixel has changed."""
    scenes, made, rows = scene_id.to_numpy(), [[], [], []], [np.zeros(0, np.int64)]
    keys, which = np.unique(np.stack([c.to_numpy() for c in (ty, tx, size, h, w, k)]), axis=1, return_inverse=True)
    for at, (j, i, n, high, wide, by) in enumerate(keys.T.tolist()):
        like = np.flatnonzero(which.ravel() == at)
        s = scenes[like][:, None, None]
        y, x = np.arange(j * n, min(high, (j + 1) * n))[:, None], np.arange(i * n, min(wide, (i + 1) * n))
        t1 = np.stack([(a * s % 256).astype(np.uint8) + ((b * x + c * y) % 256).astype(np.uint8) for a, b, c in ((31, 13, 17), (17, 29, 7), (11, 5, 23))], axis=-1)  # bytes wrap
        hit = (x >= by * (s % 10)) & (x < by * (s % 10 + 3 + s % 4)) & ((y >= by * (s * 7 % 10)) & (y < by * (s * 7 % 10 + 3 + s // 3 % 4)))
        more = (((s % 5).astype(np.uint8) + ((x + y) % 5).astype(np.uint8)) % 5)[..., None]
        t2 = np.where(hit[..., None], 255 - t1, np.minimum(t1, 255 - more) + more)
        for to, image in zip(made, (t1, t2, hit), strict=True):
            data, ends = np.ascontiguousarray(image, np.uint8), np.arange(len(like) + 1, dtype=np.int32) * image[0].size
            to.append(pa.Array.from_buffers(pa.binary(), len(like), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
        rows.append(like)
    order = pa.array(np.argsort(np.concatenate(rows)))
    return pa.StructArray.from_arrays([pa.concat_arrays([pa.array([], pa.binary()), *c]).take(order) for c in made], ["t1", "t2", "label"])


def tiles(spark: SparkSession, sf_dir: str, size: int = 32) -> DataFrame:
    """A pair of scenes for every part, as tiles of at most ``size`` pixels a side; as ``pixels``, but of several sizes."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS s")
    sides = by_scene(parts.selectExpr("s AS scene_id", f"cast({HEIGHT} AS int) AS h", f"cast({WIDTH} AS int) AS w", f"cast({SCALE} AS int) AS k"))
    grid = sides.withColumn("ty", F.explode(F.expr(f"sequence(0, cast((h - 1) div {size} AS int))"))).withColumn("tx", F.explode(F.expr(f"sequence(0, cast((w - 1) div {size} AS int))")))
    draw = F.arrow_udf(_drawn, "struct<t1: binary, t2: binary, label: binary>")  # a column, so that filters on sides come first
    drawn = grid.withColumn("size", F.lit(size)).withColumn("drawn", draw("scene_id", "ty", "tx", "size", "h", "w", "k"))
    return drawn.select("scene_id", "ty", "tx", "size", "h", "w", "drawn.t1", "drawn.t2", "drawn.label")


# the same in DuckDB
SQL_CAPTIONS = "captions AS (SELECT conv_id AS image_id, turn AS caption_idx, text, 'cat_' || (conv_id % 10) AS category FROM conversations)"
SQL_SCORES = """raw AS (SELECT l_orderkey % 128 AS scene_id, (l_quantity - 1) / 49 AS a, round(l_discount * 10, 2) AS b, (l_returnflag = 'R')::INT AS gt FROM lineitem),
scores AS (SELECT scene_id, gt, 'a' AS model, a AS score FROM raw UNION ALL SELECT scene_id, gt, 'b', b FROM raw)"""
SQL_PIXELS = (
    "px AS (" + PIXELS.format(third="(s // 3)", grid=f"(SELECT p_partkey AS s, y, x FROM part, range({SIDE}) t(y), range({SIDE}) u(x))") + "),\n"
    "pixels AS (SELECT scene_id, y, x, r1, g1, b1, " + ", ".join(f"CASE WHEN hit THEN 255 - {c}1 ELSE least(255, {c}1 + (scene_id + x + y) % 5) END AS {c}2" for c in "rgb") + ", hit::INT AS gt FROM px)"
)
#: The scenes of ``tiles`` as pixels, with the sides of each.
SQL_WIDE = (
    "sides AS (SELECT p_partkey AS s, " + f"{HEIGHT} AS h, {WIDTH} AS w, {SCALE} AS k FROM (SELECT p_partkey, p_partkey AS s FROM part)" + "), px AS ("
    "SELECT s AS scene_id, h, w, y, x, (31*s+13*x+17*y) % 256 AS r1, (17*s+29*x+7*y) % 256 AS g1, (11*s+5*x+23*y) % 256 AS b1, "
    "(x >= k * (s % 10) AND x < k * (s % 10 + 3 + s % 4) AND y >= k * (s*7 % 10) AND y < k * (s*7 % 10 + 3 + s // 3 % 4)) AS hit FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM sides))),\n"
    "pixels AS (SELECT scene_id, h, w, y, x, r1, g1, b1, " + ", ".join(f"CASE WHEN hit THEN 255 - {c}1 ELSE least(255, {c}1 + (scene_id + x + y) % 5) END AS {c}2" for c in "rgb") + ", hit::INT AS gt FROM px)"
)
