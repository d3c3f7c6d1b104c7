from orbitlake.operators.text_search import earlier


def test_images_are_ranked_in_ranges(spark):
    ids = [*range(700), *range(10**9, 10**9 + 50), -5, None]
    frame = earlier(spark.createDataFrame([(i,) for i in ids], "image_id long").repartition(7), "image_id")
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert {r["image_id"]: r["before"] for r in frame.collect()} == {i: n for n, i in enumerate(order)}
    assert earlier(spark.createDataFrame([], "image_id long"), "image_id").count() == 0
    assert "_range" in frame._jdf.queryExecution().optimizedPlan().toString()  # windows over ids are dealt by range
