"""The trie against one grown turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from orbitlake.llm import prefix_trie
from orbitlake.llm.common import cut

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in found.items()}


def with_heads(found):
    out = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = found.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])[:h] + own[h:]
    return out


def grown(found):
    members = defaultdict(list)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    def leaves(node):
        return sum(leaves(x) for x in children[node]) if children[node] else 1

    def saved(node):
        return sum(saved(x) for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)

    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(found[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves(node), saved(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize(("seed", "block", "fewest"), [(1, 7, 3), (2, 40, 40), (3, 15, 5), (4, 3, 1)])
def test_same_as_grown(spark, seed, block, fewest):
    rng = random.Random(seed)
    rows = [(c, t, "user", rng.choice("ab")) for c in range(-30, 30) for t in range(rng.choice([0, 1, 2, 3, 6]))]
    rows += [(c, t, "user", "hot") for c in range(1000, 1080) for t in range(4)]  # one conversation over many blocks
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(prefix_trie.trie(prefix_trie.sequences(frame), block, fewest)) == grown(sequences(rows))
    heads = prefix_trie.with_shared_heads(cut(prefix_trie.sequences(frame)))
    assert rows_of(prefix_trie.trie(heads, block, fewest)) == grown(with_heads(sequences(rows)))


def test_nulls_ties_repeats_and_names(spark):
    rows = [(1, None, None, None), (1, 0, "user", "é" * 3), (1, 0, "a", "x"), (1, 0, "a", "x"), (2, 0, "", ""), (None, 0, "user", "x"), (3, 5, "user", "long " * 50_000), (4, None, "r", None)]
    frame = spark.createDataFrame([(*r, 7, "k", 1) for r in rows], SCHEMA + ", chars int, key string, block int")
    assert rows_of(prefix_trie.prefix_trie(frame)) == grown(sequences(rows))


def test_empty_table(spark):
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []


def test_turns_of_other_splits_differ(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc")]
    assert len(rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))) == 3


def test_query_against_sql(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "b", None])) for c in [*range(0, 12), *range(-103, -98), 200, 201, 305] for t in range(rng.randrange(1, 9))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.SQL}) q").fetchall()
    assert rows_of(prefix_trie.op13_prefix_trie(spark, str(tmp_path))) == sorted(want, key=str) == grown(with_heads(sequences(rows)))
