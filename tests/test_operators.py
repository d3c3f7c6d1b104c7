import duckdb
import pytest

import __spark_entry__ as entry
from orbitlake.operators.graph import connected_components
from orbitlake.operators.text_search import loo_ranks, tokenize

SF = "/root/testdata/sf0.001"


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (5, 5), (3, 4), (None, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert connected_components(edges.limit(0)).count() == 0


def test_tokens_need_ascii_words(spark):
    rows = spark.createDataFrame([("Der café x_y isn't 42",), (None,)], "text string")
    assert [r[0] for r in rows.select(tokenize(rows["text"])).collect()] == [["der", "isn", "t", "42"], []]


def test_leave_one_out(spark):
    caps = spark.createDataFrame([(1, 0, "an airport", "a"), (1, 1, "planes here", "a"), (2, 0, "a river", "b"), (2, 1, "a river", "b")], "image_id long, caption_idx int, text string, category string")
    found = {r["query"]: (r["score"], r["rank"]) for r in loo_ranks(caps).collect()}
    assert found["1_cap0"] == (0.0, 1) and found["2_cap0"][0] > 0


@pytest.mark.parametrize("name", ["h6_bm25_leave_one_out_metrics", "d8_calibrated", "d17_wilcoxon", "l1_morphology", "j18_quality_gate", "b2_categories", "c2_pair_completeness", "d9_otsu", "d28_gamma_sweep", "j9_shift", "k2_padded_patches", "m3_estimate_shift", "d20_robustness", "d30_gating_ablation", "k2_patches", "k3_reconstruct", "k5_pixels_to_tiles", "d14_failures", "d16_bootstrap", "e4_top_lists", "n1_parse_responses", "l3_region_details", "l7_region_totals", "k1_patch_grid", "m4_apply_shift"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "lineitem", "part", "documents", "labels", "embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: str([float(x) if isinstance(x, (int, float)) else x for x in r])
    assert sorted(map(key, rows)) == sorted(key(r) for r in df.select(*cols).collect())


def test_shifts_are_found(spark):
    found = entry.queries()["m3_estimate_shift"](spark, SF).collect()
    assert found and all((r["dy"], r["dx"], r["err"]) == (r["scene_id"] % 5 - 2, r["scene_id"] % 2, 0.0) for r in found)


def test_border_weights():
    from orbitlake.operators.kernels import gaussian

    w = gaussian(2)
    assert len(w) == 9 and abs(w[0] + 2 * sum(w[1:]) - 1) < 1e-12
