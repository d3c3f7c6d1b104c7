import numpy as np

from orbitlake.operators.splits import make_split, positions
from orbitlake.operators.vectors import search


def test_positions_are_gapless(spark):
    rows = spark.range(500).withColumnRenamed("id", "doc_id")
    assert sorted(r["pos"] for r in positions(rows, "doc_id", "7").collect()) == list(range(500))
    sizes = {r["split"]: r["count"] for r in make_split(rows, "doc_id").groupBy("split").count().collect()}
    assert sizes == {"train": 350, "val": 75, "test": 75}


def test_search_against_brute_force(spark):
    v = np.random.default_rng(1).normal(size=(60, 8))
    v[7] = v[3]  # a tie
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(u @ u.T, 9)
    expected = {(q, int(i), r + 1) for q in (0, 20, 40) for r, i in enumerate(np.argsort(-score[q], kind="stable")[:5])}
    found = search(df.where("vec_id % 20 = 0"), df, 5)
    assert {(r["query"], r["vec_id"], r["rank"]) for r in found.collect()} == expected
