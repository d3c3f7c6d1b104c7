"""Pixel tables: scenes are dealt once, as keys, and nothing of a pixel's size is sent to all tasks."""

import pyarrow as pa
import pytest

from orbitlake.operators import raster, records, scenes, tiles
from orbitlake.sources import fixtures

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [scenes.j12_contrast, scenes.j20_regional_vari, records.m4_apply_shift, raster.d24_patches, scenes.k6_tile_statistics, scenes.k2_padded_patches])
def test_pixels_stay_where_their_scene_is(spark, query):
    lines = plan(query(spark, DATA)).splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    assert not any("BroadcastExchange" in line or "SortMergeJoin" in line for line in lines)
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line and "(tiles" not in line:
            below = lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]
            assert not any("Generate" in x for x in below), line  # keys of scenes only, no pixels


def test_tasks_make_a_bounded_number_of_scenes(spark, tmp_path):
    spark.range(20 * fixtures.SCENES_A_TASK).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sizes = [r["n"] for r in fixtures.pixels(spark, str(tmp_path)).where("y = 0 AND x = 0").selectExpr("spark_partition_id() AS p").groupBy("p").agg({"p": "count"}).withColumnRenamed("count(p)", "n").collect()]
    assert len(sizes) == 20 and max(sizes) < 1.5 * fixtures.SCENES_A_TASK


def test_moved_values(spark):
    rows = spark.createDataFrame([(s, y, x, 10 * y + x + 1) for s in (1, 2) for y in range(3) for x in range(3)], "scene_id long, y int, x int, v int")
    shifts = spark.createDataFrame([(1, 1, -1)], "scene_id long, dy int, dx int")
    found = {(r["scene_id"], r["y"], r["x"]): r["v"] for r in records.apply_shift(rows, shifts).collect()}
    assert len(found) == 18
    for (s, y, x), v in found.items():
        assert v == (10 * (y - 1) + x + 2 if s == 1 and y > 0 and x < 2 else 0)


def test_stacks_hold_a_bounded_number_of_pixels(spark, tmp_path):
    """However many scenes a task has, a kernel gets a few hundred thousand pixels at most."""

    def kernel(s):
        assert s.t1.shape[0] * s.t1.shape[1] * s.t1.shape[2] <= 1 << 18
        return pa.RecordBatch.from_pydict({"n": pa.array([len(s.scene)], pa.int64())})

    spark.range(4000).selectExpr("id * 32 + 1 AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    found = tiles.over_tiles(fixtures.tiles(spark, str(tmp_path)).coalesce(1), 8, kernel, "n long", 32)
    assert found.agg({"n": "sum"}).first()[0] == 4000
