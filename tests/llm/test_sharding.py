"""Shards: counts, slots and sizes by brute force, links kept together, odd tables."""

import glob
import os
import random
import tempfile
import time
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from orbitlake.functions.lineage import SHUFFLES_GO
from orbitlake.llm import sharding
from orbitlake.llm.common import cut


def texts():
    lines = [f"A first line that several texts share, number {i}" for i in range(40)]
    near = [f"{lines[i % 40]}\nand a body of its own {i} {i * 7}\nend {i}" for i in range(160)]
    equal = [f"equal text {i % 12} " * 5 for i in range(90)]
    alone = [f"{i} nothing else has this {i * i}" for i in range(250)]
    return [*near, *equal, *alone, None, "", None, "é" * 9, "long " * 40_000]


def rows_of(spark):
    return spark.createDataFrame([(None if i == 5 else i, t, "clash", 7, "x") for i, t in enumerate(texts())], "doc_id long, text string, unit string, n int, label string")


def test_propagation_cuts_fewer_links(spark):
    quota = [30] * 24
    _, units = sharding.units_of(cut(sharding.sized(rows_of(spark))), quota)
    first = sharding.propagate(units, quota, 0)
    before, graph = sharding.links_cut(first), sharding.propagate(units, quota)
    assert before > 150 and sharding.links_cut(graph) < 0.1 * before
    load, start = Counter(), Counter()
    for table, found in ((graph, load), (first, start)):
        for r in table.select("unit", "n", "label").distinct().collect():
            found[r["label"]] += r["n"]
    assert all(load[s] <= max(30, start[s]) for s in load)


def test_the_query(spark, tmp_path):
    rows_of(spark).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op7_sharding(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = out.collect()
    of = {i: t for i, t in enumerate(texts())}
    assert len(rows) == len(of) and sum(r["doc_id"] is None for r in rows) == 1
    slots, shards = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            data = (of[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
            shards[data].add(r["shard"])
    assert set(slots) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sum(len(shards[(f"equal text {i} " * 5).encode()]) == 1 for i in range(12)) >= 10


def test_groups_larger_than_a_shard_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "same" if i < 70 else f"t{i}") for i in range(100)], "doc_id long, text string")
    counts = Counter(r["shard"] for r in sharding.shard(docs, 10).collect())
    assert set(counts.values()) == {10}
    assert sharding.shard(docs.limit(0), 10).count() == 0
    out = sharding.shard(rows_of(spark).union(rows_of(spark).where("doc_id = 3")), 4)
    assert out.columns == ["doc_id", "text", "unit", "n", "label", "shard", "slot"] and out.count() == len(texts()) + 1


def test_slots_are_longs(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert dict(sharding.shard(rows, 2).dtypes)["slot"] == "bigint"


def test_names_of_the_plan_as_columns(spark):
    names = ["plan_k_size", "plan_k_copy", "plan_doc_id", "size", "copy", "text_hash", "doc", "bucket"]
    docs = spark.createDataFrame([(i, f"text {i % 7}", *[777] * len(names)) for i in range(50)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == 50 and all(r[n] == 777 for r in rows for n in names)


def shuffled():
    """Shuffle files on this machine."""
    tops = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")
    return {f for top in tops for f in glob.glob(f"{top}/**/blockmgr-*/*/shuffle_*.data", recursive=True)}


def test_rounds_leave_no_shuffle_files(spark):
    rows, before = cut(sharding.sized(rows_of(spark))), shuffled()
    setting = spark.conf.get(SHUFFLES_GO)
    out = sharding.shard_rows(rows)
    assert spark.conf.get(SHUFFLES_GO) == setting
    for _ in range(20):  # files go soon, not at once
        if not shuffled() - before:
            break
        time.sleep(0.5)
    assert not shuffled() - before
    assert out.count() == out.count() == len(texts())


def copies_with_other_ends():
    """Texts that differ in their first line, their beginning and their last line, and share what lies between, but for a word."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    for i in range(40):
        body = [word() for _ in range(300)]
        for j in range(3):
            body[100 * j] = word()
            yield i, f"{word()} {word()} is the heading of copy {j} of {i}, {word()}\n{' '.join(body)}\n{word()} ends copy {j} of text {i}"


def test_texts_that_share_their_middle_are_linked(spark):
    texts = list(copies_with_other_ends())
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    groups = defaultdict(list)
    for r in sharding.sized(docs).collect():
        groups[texts[r["doc_id"]][0]].append(set(r["pieces"]))
    assert all(a & b for g in groups.values() for a in g for b in g)
    _, units = sharding.units_of(cut(sharding.sized(docs)), [30] * 24)
    first, last = (sharding.propagate(units, [30] * 24, rounds) for rounds in (0, sharding.ROUNDS))
    assert sharding.links_cut(last) < 0.2 * sharding.links_cut(first)


def test_passages_hold_the_whole_text(spark):
    text = "One line  with two spaces\n\n" + " ".join(f"word{i}" for i in range(500)) + "\nlast"
    found = spark.createDataFrame([(text,)], "text string").select(sharding.passages(F.col("text")).alias("p")).first()["p"]
    assert " ".join(found).split() == text.split() and len(found) > 10
