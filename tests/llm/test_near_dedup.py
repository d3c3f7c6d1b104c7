"""Near-duplicates where rows lack a doc_id."""

from orbitlake.llm import near_dedup


def test_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = f"{text} x", "nothing of the kind stands anywhere else in this table"
    rows = spark.createDataFrame([(3, text), (None, text), (5, text), (7, near), (None, other), (None, other), (None, None)], "doc_id long, text string")
    found = near_dedup.near_duplicates(rows, 2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"] is not None) == [(3, 3), (5, 3), (7, 3)]
    assert sorted((r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is None) == [(0, None), (9, None), (9, None), (59, 3)]
    kept = near_dedup.keep_one(rows, 2).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "None", "None", "None", "None"]
