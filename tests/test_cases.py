"""Reports, target ranks and neighbours on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.operators import cases, raster, text_search, vectors

REGIONS = "scene_id long, region_id int, pixel_area long, area_ratio double, gsd double"


def test_report_lines(spark):
    regions = spark.createDataFrame([(1, 1, 1600, 0.025, 0.5), (1, 2, 400, 0.00625, 0.5), (2, 1, 12, 0.0, None)], REGIONS)
    findings = spark.createDataFrame([(1, 2, "demolition", True)], "scene_id long, region_id int, category string, review boolean")
    gate = spark.createDataFrame([(2, "aligned", 0.75)], "scene_id long, status string, confidence double")
    one, two = cases.region_report(regions, findings, gate).orderBy("scene_id").collect()
    assert one["regions"] == "#1: 1,600 pixels (2.50% of canvas) [~400.0 m² based on GSD=0.50 m/px]\n#2: 400 pixels (0.62% of canvas) [~100.0 m² based on GSD=0.50 m/px]"
    assert one["registration"] == cases.BYPASSED and two["registration"] == "Co-registration status: aligned (confidence score: 0.750)."
    assert one["review"].startswith("Inspect Region #2 ") and "\n" not in one["review"] and two["review"] == "Spot-check primary change site (Region #1, 12 pixels)."
    assert cases.NO_GSD not in one["limitations"] and two["limitations"].endswith(cases.NO_GSD) and "m²" not in two["regions"]
    assert one["summary"].endswith("suggest demolition, unverified.")
    assert cases.region_report(regions.limit(0), findings, gate).count() == 0


def test_case_evidence(spark):
    rows = spark.createDataFrame([(1, True, "success", 5), (2, True, "rejected", 5), (3, False, "success", 5)], "id int, has_ground_truth boolean, status string, gt_pixels int")
    found = {r["id"]: (r["gt_pixels"], r["evidence"]) for r in cases.case_table(rows).collect()}
    assert found == {1: (5, cases.QUANTITATIVE), 2: (None, cases.QUALITATIVE), 3: (None, cases.QUALITATIVE)}


def test_corners_join_or_part(spark):
    mask = spark.createDataFrame([(7, 0, 0, 1), (7, 1, 1, 1), (7, 1, 2, 1), (7, 4, 4, 1)], "scene_id long, y int, x int, m int")
    count = lambda diagonal: raster.components(mask, diagonal).select("label").distinct().count()
    assert (count(True), count(False)) == (2, 3)


def test_vector_targets_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    v = np.random.default_rng(3).normal(size=(40, 4))
    v[9] = v[4]  # a tie
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 3 = 0").withColumn("target", F.when(F.col("vec_id") == 0, 99).otherwise((F.col("vec_id") * 7 + 4) % 40))  # 99 is no vector
    score = np.round(v @ v.T, 9)
    want = {}
    for q in range(3, 40, 3):
        order = sorted(range(40), key=lambda i: (-score[q, i], i))
        want[q] = order.index((q * 7 + 4) % 40) + 1
    assert {r["query"]: r["rank"] for r in vectors.target_ranks(asked, rows).collect()} == want


def test_labels_rank_ties_by_image(spark):
    caps = spark.createDataFrame([(i, 0, t, "c") for i, t in enumerate(["river bank near wood", "airport with planes", "river bank and road", "", "river"])], "image_id long, caption_idx int, text string, category string")
    asked = caps.where("image_id IN (2, 3)")
    found = {r["image_id"]: r["rank"] for r in text_search.target_ranks(caps, text_search.category_docs(caps), asked).collect()}
    # image 2 meets its own label best; the blank caption scores no image, so that its image stands in order of ids
    assert found == {2: 1, 3: 4}


def test_whole_gallery_in_bands(spark, monkeypatch):
    monkeypatch.setattr(text_search, "DOCS_A_BLOCK", 3)
    gallery = spark.range(0, 20).withColumnRenamed("id", "doc")
    given = {("q", d): s for d, s in ((3, 0.5), (9, 0.5), (4, 0.51), (17, 2.25), (0, 0.01))}
    scores = spark.createDataFrame([(q, d, s) for (q, d), s in given.items()], "query string, doc long, score double")
    queries = spark.createDataFrame([("q",), ("none",)], "query string")
    rows = text_search.rank_gallery(queries, scores, gallery).collect()
    for q in ("q", "none"):
        order = sorted(range(20), key=lambda d: (-given.get((q, d), 0), d))
        assert [r["doc"] for r in sorted((r for r in rows if r["query"] == q), key=lambda r: r["rank"])] == order
        assert sorted(r["rank"] for r in rows if r["query"] == q) == list(range(1, 21))


def test_whole_gallery_from_lists(spark, monkeypatch):
    for name, n in (("DOCS_A_BLOCK", 7), ("DOCS_A_BAND", 3), ("FEWEST_QUERIES", 2), ("RANKS_A_BATCH", 4)):
        monkeypatch.setattr(text_search, name, n)
    words = ["river bank", "river", "airport with planes near river", "", None, "wood", "planes planes", "bank of wood"]
    docs = spark.createDataFrame([(7 * i % 31, words[i % 8]) for i in range(31)] + [(None, "river"), (3, "airport")], "doc long, text string")
    queries = spark.createDataFrame([("a", "river bank"), ("b", "planes"), ("c", ""), ("d", "unheard"), (None, "river"), ("e", "wood wood of airport")], "query string, text string")
    want = text_search.rank_gallery(queries, text_search.bm25(queries, text_search.index(docs)), docs)
    found = text_search.search_gallery(queries, docs)
    rows = [sorted(((r["query"] or "", r["rank"], r["doc"], round(r["score"], 6)) for r in x.collect())) for x in (found, want)]
    unnamed = [r for r in rows[0] if not r[0]]
    assert [r for r in rows[0] if r[0]] == rows[1]
    assert len(rows[1]) == 5 * 32
    assert [(r[1], r[3]) for r in unnamed] == [(i, 0.0) for i in range(1, 33)]  # as in SQL; ranks by joins leave it out


@pytest.mark.parametrize(("confidence", "said"), [(0.5085, "0.508"), (0.5094, "0.509"), (0.0625, "0.063"), (1.0, "1.000"), (0.0, "0.000")])
def test_confidence_to_three_places(spark, confidence, said):
    regions = spark.createDataFrame([(1, 1, 10, 0.5, None)], REGIONS)
    findings = spark.createDataFrame([], "scene_id long, region_id int, category string, review boolean")
    gate = spark.createDataFrame([(1, "moderate", confidence)], "scene_id long, status string, confidence double")
    assert cases.region_report(regions, findings, gate).first()["registration"].endswith(f"{said}).")
