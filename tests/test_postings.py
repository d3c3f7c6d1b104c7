"""Searches with bounds against scores of all documents."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from orbitlake.functions.lineage import checkpoint_folder
from orbitlake.operators import postings, text_search
from orbitlake.sources import fixtures

WORDS = [f"w{i}" for i in range(60)]


def corpus(seed, n=150):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(60)]
    return {i * 3: " ".join(rng.choices(WORDS, weights, k=rng.randrange(1, 30))) for i in range(n)}


def scores(query, docs):
    tf = {d: Counter(t.split()) for d, t in docs.items()}
    df, avg = Counter(w for c in tf.values() for w in c), sum(sum(c.values()) for c in tf.values()) / len(tf)
    out = {}
    for d, c in tf.items():
        s = sum(q * math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / (avg + 1e-9)) + 1e-9) for w, q in Counter(query.split()).items() if w in c)
        out[d] = round(s, 9)
    return out


@pytest.mark.parametrize(("k", "block"), [(1, 2000), (7, 20), (200, 40)])
def test_search_is_whole(spark, monkeypatch, k, block):
    monkeypatch.setattr(text_search, "DOCS_A_BLOCK", block)
    docs = corpus(1)
    asked = {"a": "w0 w1 w1", "b": "w59 w58", "c": "nothing known", "d": "", "e": docs[30]}
    found = defaultdict(list)
    frames = spark.createDataFrame([*asked.items()], "query string, text string"), spark.createDataFrame([*docs.items()], "doc long, text string")
    for r in text_search.search(*frames, k).orderBy("query", "rank").collect():
        found[r["query"]].append((r["rank"], r["doc"], round(r["score"], 6)))
    for q, text in asked.items():
        best = sorted((-s, d) for d, s in scores(text, docs).items())[:k]
        assert found[q] == [(i + 1, d, round(-s, 6)) for i, (s, d) in enumerate(best)]


def test_owners_are_ranked_by_their_best_document(spark):
    docs = corpus(2)
    frame = spark.createDataFrame([(d, t, d % 10) for d, t in docs.items()], "doc long, text string, owner long")
    found = text_search.search(spark.createDataFrame([("q", "w3 w20 w5")], "query string, text string"), frame, 4).orderBy("rank").collect()
    most = defaultdict(float)
    for d, s in scores("w3 w20 w5", docs).items():
        most[d % 10] = max(s, most[d % 10])
    assert [(r["doc"], round(r["score"], 6)) for r in found] == [(d, round(-s, 6)) for s, d in sorted((-s, d) for d, s in most.items())[:4]]


def lists(rng, docs, terms):
    held = [np.sort(rng.choice(docs, rng.integers(1, docs), replace=False)) for _ in range(terms)]
    weights = [np.exp(rng.normal(size=len(h)) * 1.5) for h in held]
    return pa.table({"term": [str(i) for i in range(terms)], "docs": pa.array([h.tolist() for h in held]), "weights": pa.array([w.tolist() for w in weights])}), held, weights


@pytest.mark.parametrize("seed", range(5))
def test_bounds_spare_documents_and_lose_none(seed):
    rng = np.random.default_rng(seed)
    table, held, weights = lists(rng, 4000, 12)
    block = postings.Postings(table)
    for terms in ([0], [1, 2, 3], [4, 9], list(range(12))):
        qtf = rng.integers(1, 3, len(terms))
        whole = np.zeros(4000)
        for t, q in zip(terms, qtf):
            whole[held[t]] += q * weights[t]
        order = np.lexsort((np.arange(4000), -np.round(whole, 9)))[:10]
        ids, found = block.best(np.array(terms), qtf, 10)
        assert block.owners.take(pa.array(ids)).to_pylist() == order.tolist() and np.allclose(found, whole[order])
        met, s = block.reaching(np.array(terms), qtf, found[-1])
        assert set(order) <= set(block.names.take(pa.array(met)).to_pylist())
    assert block.scored < 0.6 * block.seen


def test_empty_block():
    block = postings.Postings(pa.table({"term": pa.array([], pa.string()), "docs": pa.array([], pa.list_(pa.int64())), "weights": pa.array([], pa.list_(pa.float64()))}))
    assert len(block.names) == 0 and block.runs == 0


def test_searches_keep_columns_not_checkpoints(spark):
    caps = fixtures.captions(spark, "/root/testdata/sf0.001")
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*/rdd-*")) | set(folder.glob("rdd-*"))
    assert text_search.loo_ranks(caps).count() == caps.count()
    assert not (set(folder.glob("*/rdd-*")) | set(folder.glob("rdd-*"))) - before


def test_a_query_is_one_row_a_block_of_documents(spark, monkeypatch):
    monkeypatch.setattr(text_search, "DOCS_A_BLOCK", 5)
    docs = spark.createDataFrame([(i, f"w{i} w{i % 3} common") for i in range(20)], "doc long, text string")
    queries = spark.createDataFrame([("q", "w1 w2 w3 w1 common")], "query string, text string")
    terms = queries.select("query", F.explode(text_search.tokenize(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    count = lambda of, lists: pa.table({"n": pa.array([len(of)], pa.int64()), "docs": pa.array([len(pc.unique(lists["docs"].combine_chunks().flatten()))], pa.int64())})
    blocks = text_search.in_blocks(terms, text_search.index(docs), (1, 20), count, "n long, docs long")
    assert "collect_list(struct(term" in blocks._jdf.queryExecution().optimizedPlan().toString()
    assert [r["n"] for r in blocks.collect()] == [4] * 4


def test_best_captions_of_all_images(spark):
    """Every image that shares a word with a caption is there, not only the first ten."""
    data = "/root/testdata/sf0.001"
    caps = fixtures.captions(spark, data).select(text_search.query_id().alias("query"), "image_id", F.array_distinct(text_search.tokenize(F.col("text"))).alias("w"))
    words = [(r["query"], r["image_id"], set(r["w"])) for r in caps.collect()]
    want = {(q, other) for q, _, w in words for _, other, o in words if w & o}
    rows = text_search.h5_max_caption(spark, data).collect()
    found = Counter(r["query"] for r in rows)
    assert {(r["query"], r["image_id"]) for r in rows} >= want and len({(r["query"], r["image_id"]) for r in rows}) == len(rows)
    assert max(found.values()) > 10


def test_many_queries_score_as_single_ones():
    """Scores of a product and of added postings together are those of each query's own postings, for owners as well."""
    rng = np.random.default_rng(7)
    table, held, weights = lists(rng, 900, 40)
    rare = pa.table({"term": [f"r{i}" for i in range(200)], "docs": pa.array([[int(x)] for x in rng.integers(0, 900, 200)]), "weights": pa.array([[float(x)] for x in rng.random(200)])})
    table = pa.concat_tables([table, rare])
    block = postings.Postings(table.append_column("owners", pa.array([[d % 70 for d in x] for x in table["docs"].to_pylist()])))
    names = [f"q{i}" for i in range(300)]
    each = [sorted(set(rng.choice(table["term"].to_pylist(), rng.integers(1, 30)))) for _ in names]
    number = np.repeat(np.arange(len(names)), [len(t) for t in each])
    flat = [t for ts in each for t in ts]
    rows = pa.table({"query": pa.DictionaryArray.from_arrays(pa.array(number, pa.int32()), pa.array(names)), "term": pa.array(flat).dictionary_encode(), "qtf": pa.array(rng.integers(1, 4, len(flat)))})
    asked = postings.Asked(rows, block.terms)
    whole, at = np.zeros((len(names), 900)), {t: i for i, t in enumerate(table["term"].to_pylist())}
    docs, held = table["docs"].to_pylist(), table["weights"].to_pylist()
    for q, t, f in zip(number, flat, rows["qtf"].to_pylist(), strict=True):
        whole[q, docs[at[t]]] += f * np.array(held[at[t]])
    most = np.stack([whole[:, np.arange(900) % 70 == o].max(axis=1) for o in range(70)], axis=1)
    found = np.concatenate([block.by_owner(s).copy() for _, s in block.every(asked)])
    assert np.allclose(found[:, block.owners.to_numpy().argsort()], most) and len(block.owners) == 70
    for i, t, f in list(asked.each())[:20]:
        one = block.best(t, f, 5)
        query, owner, score = block.best_of_each(asked, 5)
        mine = [x[query == i] for x in (owner, score)]
        by = np.lexsort((mine[0], -mine[1]))[:5]
        assert mine[0][by].tolist() == one[0].tolist() and np.allclose(mine[1][by], one[1])


@pytest.mark.parametrize("search", ["search", "search_gallery"])
def test_a_block_is_kept_once_whatever_the_number_of_others(spark, monkeypatch, search):
    """No row of terms or lists is shuffled again for each block that it meets."""
    monkeypatch.setattr(text_search, "DOCS_A_BLOCK", 5)
    docs = spark.createDataFrame([(i, f"w{i} w{i % 3} common") for i in range(20)], "doc long, text string")
    queries = spark.createDataFrame([(f"q{i}", f"w{i} common") for i in range(8)], "query string, text string")
    plan = getattr(text_search, search)(queries, docs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan


def test_all_images_are_ranked_without_a_shuffle_of_pairs(spark, monkeypatch):
    """The rows of a search for all that share a term, and their order, by brute force; they come from the task that scores them."""
    monkeypatch.setattr(text_search, "DOCS_A_BLOCK", 40)
    docs = corpus(3)
    asked = {"a": "w0 w1 w1", "b": "w59", "c": "nothing known", "d": "", "e": docs[30]}
    frames = spark.createDataFrame([*asked.items()], "query string, text string"), spark.createDataFrame([*docs.items()], "doc long, text string")
    out = text_search.search(*frames, 10, every=True)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    found = defaultdict(list)
    for r in out.orderBy("query", "rank").collect():
        found[r["query"]].append((r["rank"], r["doc"], round(r["score"], 6)))
    for q, text in asked.items():
        best = sorted((-s, d) for d, s in scores(text, docs).items())
        best = best[: max(10, sum(s < 0 for s, _ in best))]
        assert found[q] == [(i + 1, d, round(-s, 6)) for i, (s, d) in enumerate(best)]
