"""The language model: base figures by brute force, one result for any partitioning, memory, and odd tables."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np

from orbitlake.llm import lm_scoring
from tests.llm.test_sharding import shuffled


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab) for _ in range(120)) for _ in range(60)]
    return [*texts, texts[0], texts[7], None, "", " \n", "Ünïcode " * 30, "x" * 5000, "ab " * 30_000, "Once ONCE once"]


def scored(docs):
    return {r["doc_id"]: r for r in lm_scoring.score(docs, lm_scoring.learn(docs.where("train"))).collect()}


def test_base_figures_and_partitions(spark):
    texts = corpus()
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    rows = [(i, t, not h, "clash", 1) for i, (t, h) in enumerate(zip(texts, held))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean, h string, row int")
    counts = Counter(x for t, h in zip(texts, held) if not h for x in words(t))
    total, v = counts.total(), len(counts)
    found = scored(docs.repartition(1))
    for i, t in enumerate(texts):
        r, w = found[i], words(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    assert {i: r["score"] for i, r in found.items()} == {i: r["score"] for i, r in scored(docs.repartition(7)).items()}
    again = {i for i in (0, 7, 60, 61) if not held[i]}
    twins = {i for i in again if any(j != i and texts[j] == texts[i] and not held[j] for j in again)}
    once = [r["bits_per_byte"] for i, r in found.items() if i < 60 and i not in (0, 7)]
    assert twins and all(found[i]["bits_per_byte"] < 0.5 * min(once) for i in twins)


def test_the_query(spark, tmp_path):
    texts = corpus()
    spark.createDataFrame([(i, t, "en", None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lm_scoring.op6_lm_scoring(spark, str(tmp_path))
    assert rows.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {r["doc_id"]: r["held_out"] for r in rows.collect()} == {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}


def test_tables_without_rows_or_training(spark):
    docs = spark.createDataFrame([(1, "a b", False), (None, None, False)], "doc_id long, text string, train boolean")
    assert scored(docs.limit(0)) == {}
    found = scored(docs)
    assert found[1]["n_known"] == 0 and found[1]["base_score"] == 0 and found[1]["score"] < 0 and found[None]["n_tokens"] == 1


def test_probabilities_of_a_code_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(corpus())], "doc_id long, text string, train boolean")
    book = lm_scoring.learn(docs)["book"]
    assert abs(sum(0.5 ** float(n) for n in book["length"]) - 1) < 1e-12
    assert len({(int(n), int(c)) for n, c in zip(book["length"], book["code"])}) == len(book["n"])


def test_a_byte_in_its_context_is_spelled_once(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(corpus())], "doc_id long, text string, train boolean")
    mix = lm_scoring.learn(docs)["letters"]
    data = np.frombuffer(b"w1 w12 w12 banana nana w1 bananas ", np.uint8)
    first = np.append(0, np.flatnonzero(data[:-1] == lm_scoring.SPACE) + 1)
    plain = lm_scoring._bits(mix, lm_scoring.Letters(data, first), lm_scoring._letter_gate)
    speller, asked = lm_scoring.Speller(mix), []
    bits = lm_scoring._bits
    lm_scoring._bits = lambda m, decisions, *rest: asked.append(len(decisions.order)) or bits(m, decisions, *rest)
    try:
        assert np.allclose(speller.of_bytes(data, first), plain, rtol=1e-6) and np.allclose(speller.of_bytes(data, first), plain, rtol=1e-6)
    finally:
        lm_scoring._bits = bits
    assert len(asked) == 1 and asked[0] < len(data)


def test_learning_and_scoring_leave_no_shuffle_files(spark):
    docs, before = spark.createDataFrame([(i, t, True) for i, t in enumerate(corpus())], "doc_id long, text string, train boolean"), shuffled()
    out = lm_scoring.score(docs, lm_scoring.learn(docs))
    for _ in range(20):  # files go soon, not at once
        if not shuffled() - before:
            break
        time.sleep(0.5)
    assert not shuffled() - before
    assert out.count() == len(corpus())
