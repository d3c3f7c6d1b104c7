"""Jobs that have to fail, and the samples and checks of splits."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orbitlake.functions import contracts
from orbitlake.operators import evaluation, records, splits


def test_guards_fail_only_where_rows_are_broken(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    assert contracts.not_empty(rows, "none").count() == 3 and contracts.unique(rows.where("v <> 'c'"), "k").count() == 2
    for broken, said in ((contracts.not_empty(rows.where("k > 5"), "nothing there"), "nothing there"), (contracts.unique(rows, "k"), "more than once: 2"), (contracts.guarded(rows, rows, F.col("k") == 1, F.concat(F.lit("bad "), "v")), "bad a")):
        for read in (lambda f: f.collect(), lambda f: f.count(), lambda f: f.select("v").collect()):
            with pytest.raises(PySparkException, match=said):
                read(broken)


def test_pairs_scores_and_splits_that_cannot_be(spark):
    a, b = (spark.createDataFrame([(x,)], "stem string") for x in "ab")
    with pytest.raises(PySparkException, match="no pairs"):
        records.pair_scenes(a, b, a).collect()
    with pytest.raises(PySparkException, match="no scores"):
        evaluation.curve(spark.createDataFrame([], "model string, bin int, pos long, neg long")).collect()
    ids = spark.range(10).withColumnRenamed("id", "doc_id")
    with pytest.raises(ValueError, match="add up"):
        splits.make_split(ids, "doc_id", shares=(0.7, 0.2, 0.2))
    with pytest.raises(PySparkException, match="doc_id occurs more than once"):
        splits.make_split(ids.union(ids.limit(1)), "doc_id").collect()


def test_one_point_is_calibrated(spark):
    rows = spark.createDataFrame([("m", 0.8, 1), ("m", 0.2, 0)], "model string, score double, gt int")
    best = evaluation.first_best(evaluation.curve(evaluation.histogram(rows)), ["model"]).first()
    assert best["f1"] == 1.0 and 0.2 < best["tau"] <= 0.8


def test_balanced_samples(spark):
    rows = spark.createDataFrame([(i, i < 20) for i in range(200)], "id long, p boolean")
    take = lambda **k: {r["id"] for r in splits.balanced_sample(rows, "id", F.col("p"), **k).collect()}
    first = take(n=30)
    assert len(first) == 30 and sum(i < 20 for i in first) == 15 and first == take(n=30) != take(n=30, epoch=1)
    short, full = take(n=100), take(n=100, fill=True)
    assert len(short) == 70 and sum(i < 20 for i in short) == 20
    assert len(full) == 100 and sum(i < 20 for i in full) == 20


def test_overlap_and_gallery(spark):
    manifest = spark.createDataFrame([(1, "train"), (1, "test"), (2, "val"), (3, "test"), (3, "val"), (3, "train"), (4, "train"), (4, "train")], "id long, split string")
    assert {tuple(r) for r in splits.split_overlap(manifest, "id").collect()} == {("test", "train", 1), ("test", "train", 3), ("test", "val", 3), ("train", "val", 3)}
    split = spark.createDataFrame([(1, "test"), (2, "test"), (3, "train"), (4, "val")], "id long, split string")
    gallery = spark.createDataFrame([(1,), (3,), (9,)], "id long")
    assert {tuple(r) for r in splits.gallery_contract(gallery, split, "id").collect()} == {("missing from gallery", 2), ("train id in gallery", 3), ("in no split", 9)}
    assert splits.gallery_contract(split.where("split = 'test'"), split, "id").count() == 0


def test_responses_with_two_objects_and_lists(spark):
    texts = [
        'Look: {"change_category": "demolition", "alternative_interpretations": ["a", "b"], "uncertainty_reason": " haze "} done', '```json\n{"change_category": "Uncertain", "evidence_for_category": "one"}\n``` and ```x```', '{"a": 1} or {"b": 2}', "``` no fence", "",
    ]
    rows = records.parse_responses(spark.createDataFrame(list(enumerate(texts)), "id long, raw string")).orderBy("id").collect()
    assert [r["parsed"] for r in rows] == [True, True, False, False, False]
    assert (rows[0]["change_category"], rows[0]["alternatives"], rows[0]["uncertainty_reason"], rows[0]["requires_review"]) == ("demolition", "a; b", "haze", False)
    assert (rows[1]["change_category"], rows[1]["evidence"], rows[1]["alternatives"], rows[1]["requires_review"]) == ("uncertain", "one", "", True)
    assert rows[2]["change_category"] == "uncertain" and rows[2]["requires_review"]
