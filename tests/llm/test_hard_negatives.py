"""Hard negatives against all scores of all rows."""

import math

import duckdb
import numpy as np
import pytest

from orbitlake.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def expected(rows, every=100, positives=5, negatives=10):
    rows = [(i, y, [math.floor(256 * np.float64(x)) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, q in {(i, y, tuple(v)) for i, y, v in rows if i % every == 0}:
        scored = [(-sum(x * z for x, z in zip(q, v)), i, y) for i, y, v in rows]
        for s, p, _ in sorted(x for x in scored if x[2] == label and x[1] != a)[:positives]:
            near = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(near)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def rows_of(n, seed, dim=8, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, dim))
    x[: n // 3] = np.round(x[0], 2) + rng.integers(0, 2, (n // 3, 1)) / 64  # a third are nearly the same
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, int(rng.integers(0, 4)), [float(np.float32(z)) for z in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 7)])
def test_same_as_all_scores(spark, monkeypatch, seed, block):
    monkeypatch.setattr(hard_negatives, "ANCHORS_A_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "FEWEST", 100)
    rows = rows_of(900, seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(hard_negatives.mine(hard_negatives.whole_vectors(frame), every=20)) == expected(rows, every=20)


def test_nulls_repeats_ties_lengths_and_names(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, 1, [1.0]), (0, None, [1.0]), (1, 1, None), (2, 1, [1.0, None]), (3, 1, [nan]), (4, 1, [-inf]), (5, 1, [])]
    rows = [(i, i % 3, [1.0, (i % 5) / 8, -0.001]) for i in range(40)] + [(i, i % 2, [0.25 * (i % 4)] * (i % 4)) for i in range(100, 130)]
    rows += [*odd, (0, 0, [1.0, 0.0, -0.001]), (0, 0, [1.0, 0.0, -0.001]), (6, 0, [1.0, 0.75, -0.001]), (100, 0, [2.0, 1.0]), (200, 9, [1.0, 1.0]), (300, 1, [1e4] * 3), (301, 1, [1e4] * 3)]
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", q int, block int, cell string")
    assert found(hard_negatives.mine(hard_negatives.whole_vectors(frame))) == expected(rows)


def test_large_scores_are_whole_numbers(spark):
    rows = [(i, i % 2, [1_000_000.0 + i / 256, 800_000.0 - i / 256, 1.0] * 3) for i in range(30)] + [(100 + i, i % 2, [600_000.5 + i] * 9) for i in range(20)]
    frame = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    assert found(hard_negatives.mine(hard_negatives.whole_vectors(frame), every=10)) == expected(rows, every=10) != []


def test_empty_table(spark):
    assert found(hard_negatives.mine(hard_negatives.whole_vectors(spark.createDataFrame([], SCHEMA)))) == []
    alone = spark.createDataFrame([(0, 1, [1.0]), (7, 2, [1.0])], SCHEMA)
    assert found(hard_negatives.mine(hard_negatives.whole_vectors(alone))) == []


def test_bounds_spare_candidates():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-40, 40, 16) * 8 + rng.integers(-2, 3, (200, 16)) for _ in range(10)])
    label = np.repeat(np.arange(10), 200) % 2
    anchors = pa.table({"q": pa.array(x[::10].astype(np.int32).tolist()), "vec_id": np.arange(0, 2000, 10), "label": label[::10], "block": np.zeros(200, int), "positives": pa.nulls(200, pa.list_(pa.int64()))})
    block = hard_negatives.Block(hard_negatives._tree(anchors), lambda _: [hard_negatives.Best(5)], True)
    for i in range(0, 2000, 250):
        block.meet(np.arange(i, i + 250), label[i : i + 250], x[i : i + 250].astype(float))
    assert block.scored < 0.25 * block.seen
    for c, a in enumerate(block.ids):
        s = x @ x[a]
        assert block.found[c][0].ids.tolist() == [int(i) for i in np.lexsort((np.arange(2000), -s)) if label[i] == label[a] and i != a][:5]


def test_tree_is_as_short_as_kruskals():
    x = np.random.default_rng(5).integers(-9, 9, (40, 3)).astype(float)
    parent, edge = hard_negatives.spanning_tree(x)
    joined, total = list(range(40)), 0.0
    for d, a, b in sorted((float(np.linalg.norm(x[a] - x[b])), a, b) for a in range(40) for b in range(a)):
        if joined[a] != joined[b]:
            joined = [joined[b] if j == joined[a] else j for j in joined]
            total += d
    assert abs(edge[1:].sum() - total) < 1e-9 and (parent == -1).sum() == 1


def test_query_against_sql(spark, tmp_path):
    rows = rows_of(700, 8)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({hard_negatives.SQL}) q").fetchall())
    changed = [(i, (y + 1) % 10 if i % 7 == 0 else y, v) for i, y, v in rows]
    assert found(hard_negatives.op11_hard_negatives(spark, str(tmp_path))) == want == expected(changed) != []
