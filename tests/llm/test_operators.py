"""Operators against brute force on a small table with nulls, blanks, copies, repeated rows and clashing columns."""

import random
import re
from collections import Counter

import pytest

from orbitlake.llm import decontamination, mixing, near_dedup, quality_model, quality_rules, substring_dedup


def texts():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(80)) for _ in range(12)]
    near = [" ".join([*t.split()[:-2], "x", "y"]) for t in base[:4]]
    shared = "\n".join(base[5].split()[:30])
    return [*base, *near, base[0], base[0], None, "", " \n\t", "one", "One", "Mit License and CC BY", shared + " tail", "é " * 60]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "clash", i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, size long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_near_duplicates(docs, empty):
    sets = {}
    for i, t in enumerate(texts()):
        w = [x.lower() for x in words(t)]
        sets[i] = set(zip(w, w[1:])) if len(w) > 1 else set(map(tuple, [w] if w else []))
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert found == {i: (len(s), label[i]) for i, s in sets.items()}
    kept = near_dedup.keep_one(docs.union(docs.where("doc_id = 3")), 2)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label.values()))
    assert near_dedup.near_duplicates(empty).count() == 0


def test_substrings(docs, empty):
    first, expected = {}, {}
    for i, t in enumerate(texts()):
        w = words(t)
        gone = set()
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), i) < i:
                gone |= set(range(j, j + 13))
        expected[i] = (len(w), len(gone))
    rows, changed = substring_dedup.dedup(docs)
    lost = {r["doc_id"]: r["n_removed"] for r in changed.collect()}
    found = {r["doc_id"]: (r["n_words"], r["n_words"] if r["copy_of"] < r["doc_id"] and r["n_words"] > 12 else lost.get(r["doc_id"], 0)) for r in rows.collect()}
    assert found == expected
    assert substring_dedup.dedup(empty)[0].count() == 0


def test_quality_statistics(docs, empty):
    def brute(t):
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    found = {r["doc_id"]: tuple(r["q"][c] for c in quality_rules.BASE) for r in quality_rules.measured(docs, ["doc_id"]).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts())}
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and all(len(words(r["text"])) >= 50 for r in kept.collect())
    assert quality_rules.keep_good(empty).count() == 0


def test_votes_are_learnt():
    good, bad = (1, 1, 2), (0, 0, 1)  # a rule alone could not be told from chance
    prior, table = quality_rules.fit([(bad, 100), (good, 900)])
    assert 0.85 < prior < 0.95 and table[0][0][0] > 0.8 and table[0][1][0] < 0.05


def test_mixing(spark, docs, empty):
    rows = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 5) AS source", "id % 97 AS size")
    plan = mixing.solve(rows)
    taken = mixing.joined(rows, plan).withColumn("copies", mixing.copies()).groupBy("source", "target").agg({"*": "count"}).collect()
    assert len(taken) == 5
    sums = {r["source"]: (r["t"], r["target"]) for r in mixing.joined(rows, plan).selectExpr("*").withColumn("c", mixing.copies()).selectExpr("source", "target", "c * size AS w").groupBy("source", "target").agg({"w": "sum"}).withColumnRenamed("sum(w)", "t").collect()}
    assert all(abs(t - g) <= 0.01 * g for t, g in sums.values())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    assert mixing.mix(empty).count() == 0
    names = ["mix_size", "mix_source", "mix_plan", "of", "plan", "size", "doc"]
    clash = docs.drop("size").selectExpr("*", *[f"777 AS {n}" for n in names])
    rows = mixing.mix(clash).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert all(r[n] == 777 for r in rows for n in names)


def test_decontamination(spark, docs, empty):
    item = "A train leaves at 7 with 12 boxes for Maria and drives 40 km to the old harbour, where Maria unloads 12 boxes"
    other = item.replace("12", "15").replace("Maria", "Peter").replace("40", "52")
    broken = item.replace("Maria unloads 12", "Peter unloads 19")
    plain = "nothing in this text was ever part of a question about trains and boxes so it has to stay where it is"
    rows = spark.createDataFrame([(1, f"before {item} after"), (2, f"before {other} after"), (3, plain), (4, None), (5, item.upper()), (6, broken)], "doc_id long, text string")
    found = {r["doc_id"]: r["refilled"] for r in decontamination.contaminated(rows, spark.createDataFrame([(9, item), (8, None), (7, "too short")], "item_id long, text string")).collect()}
    assert found.get(1) is False and found.get(2) is True and 5 in found and 3 not in found and 4 not in found
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(rows, bench).collect())[:2] == [3, 4]
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0 and decontamination.contaminated(rows, bench.limit(0)).count() == 0


def test_quality_model():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality_model.STATISTICS)))
    y = (x[:, 3] + x[:, 5] > 0).astype(float)
    p = quality_model.fit(x[:400], y[:400]).predict(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.85
    assert quality_model.fit(x[:0], y[:0]).predict(x[:3]).tolist() == [0.5] * 3
    assert quality_model.statistics(None) == quality_model.statistics(" ")
