"""Blocks of BM25 scores against the plain join, and small cases of records."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbitlake.operators import records, text_search
from orbitlake.sources import fixtures

DATA = "/root/testdata/sf0.001"


def test_blocks_score_like_the_join(spark, monkeypatch):
    monkeypatch.setattr(text_search, "QUERIES_A_BLOCK", 20)
    monkeypatch.setattr(text_search, "DOCS_A_BLOCK", 3)
    caps = fixtures.captions(spark, DATA)
    queries, docs = caps.select(text_search.query_id().alias("query"), "text"), text_search.image_docs(caps)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    plain = text_search.bm25(queries, text_search.index(docs)).withColumn("rank", F.row_number().over(order)).where("rank <= 4")
    wanted = {(r["query"], r["rank"]): (r["doc"], round(r["score"], 6)) for r in plain.collect()}
    found = {(r["query"], r["rank"]): (r["doc"], round(r["score"], 6)) for r in text_search.search(queries, docs, 4).collect()}
    assert {k: v for k, v in found.items() if v[1] > 0} == wanted and len(wanted) > 20 and len(found) == 4 * queries.count()
    assert text_search.search(queries.limit(0), docs).count() == 0 and text_search.search(queries, docs.limit(0)).count() == 0


def test_leave_one_out_in_blocks(spark, monkeypatch):
    caps = fixtures.captions(spark, DATA)
    whole = sorted(map(tuple, text_search.loo_ranks(caps).collect()))
    monkeypatch.setattr(text_search, "QUERIES_A_BLOCK", 20)
    monkeypatch.setattr(text_search, "DOCS_A_BLOCK", 3)
    assert sorted(map(tuple, text_search.loo_ranks(caps).collect())) == whole


def test_responses(spark):
    raws = ['```json\n{"change_category": "Demolition", "visual_observation": " gone "}\n```', "no", None, '{"change_category": "other", "evidence_for_category": "one", "requires_human_review": false}', 'so: {"a": [1, 2]} .', '{"broken": ']
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    found = [tuple(r) for r in records.parse_responses(rows).orderBy("id").collect()]
    assert found[0] == (0, True, "demolition", "gone", records.EVIDENCE, "", None, False)
    assert [r[1] for r in found] == [True, False, False, True, True, False]
    assert found[1][2:] == ("uncertain", records.NO_OBSERVATION, records.NO_EVIDENCE, "", None, True)
    assert found[3][2:] == ("uncertain", records.OBSERVATION, "one", "", None, False) and found[4][7]


def test_grids(spark):
    images = spark.createDataFrame([(1024, 1024), (300, 300), (100, 300)], "w int, h int")
    counts = lambda size, stride, pad: {(r["w"], r["h"]): r["count"] for r in records.patch_grid(images, size, stride, pad).groupBy("w", "h").count().collect()}
    assert counts(256, 256, False) == {(1024, 1024): 16, (300, 300): 1}
    assert counts(256, 128, False)[1024, 1024] == 49
    assert counts(256, 256, True) == {(1024, 1024): 16, (300, 300): 4, (100, 300): 2}


def test_samples_and_suffixes(spark):
    ids = spark.range(45).withColumnRenamed("id", "k")
    assert sorted(r["k"] for r in records.stride_sample(ids, "k", 10).collect()) == list(range(0, 40, 4))
    names = spark.createDataFrame([("a_12",), ("a_x",), ("7",)], "n string")
    assert [r[0] for r in names.select(records.suffix_number(F.col("n"))).collect()] == [12, 9999, 7]
