"""The pipeline's stages, each on what the one before kept, against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline

ITEM = "A train leaves at 7 with 12 boxes for Maria and drives 40 km to the old harbour, where Maria unloads 12 boxes"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def texts():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choice(vocab) + ("." if i % 9 == 8 else "") for i in range(n))

    base = [prose(rng.randint(60, 300)) for _ in range(120)]
    near = [" ".join([*words(t)[:-1], "changed"]) for t in base[:10] if len(words(t)) > 90]
    leaked = [f"{prose(70)} {ITEM} {prose(40)}" for _ in range(6)]
    refilled = [f"{prose(70)} {ITEM.replace('12', '15').replace('Maria', 'Peter')} {prose(40)}"]
    return [*base, *near, *base[:8], *leaked, *refilled, "short", "#*$ " * 80, "same three words " * 60, None, "", prose(30_000)]


def near_groups(rows):
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for w in [[x.lower() for x in words(r["text"])]] for i in range(len(w) - 4)} for r in rows}
    label = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[b] = min(label[a], label[b])
    return label


def test_stages(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    good = {r["doc_id"] for r in kept["quality_rules"]}
    bad = {i for i, t in enumerate(texts()) if len(words(t)) < 50 or t.startswith(("#*$", "same three"))}
    assert good == set(range(len(rows))) - bad
    groups = near_groups(kept["quality_rules"])
    assert {r["doc_id"] for r in kept["near_dedup"]} == set(groups.values()) and len(set(groups.values())) < len(groups) - 8
    leaked = {i for i, t in enumerate(texts()) if t and "leaves at 7 with" in t}
    assert {r["doc_id"] for r in kept["decontamination"]} == set(groups.values()) - leaked
    size = {r["doc_id"]: len(words(r["text"])) for r in kept["decontamination"]}
    source = {r["doc_id"]: r["source"] for r in kept["decontamination"]}
    every, taken, copies = Counter(), Counter(), Counter(r["doc_id"] for r in kept["mixing"])
    for i, n in size.items():
        every[source[i]] += n
        taken[source[i]] += n * copies[i]
    assert max(copies.values()) <= 2
    order = sorted(every, key=lambda s: (s is None, s or ""))
    target, free, left = {}, list(order), 1.5 * sum(every.values())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > 2 * every[s]]
        if not full:
            target |= {s: share * weight[s] for s in free}
            break
        for s in full:
            target[s], left = 2 * every[s], left - 2 * every[s]
            free.remove(s)
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], longest if s == source[max(size, key=size.get)] else 300) for s in order)
    counts = Counter(r["shard"] for r in kept["sharding"])
    assert sum(counts.values()) == sum(copies.values()) and max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
