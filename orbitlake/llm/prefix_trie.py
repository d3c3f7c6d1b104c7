"""The trie of shared beginnings of conversations, from range minima over sorted LCPs.

A turn is 16 bytes of the SHA-256 of its role and text, a conversation the bytes of its turns.
Conversations are sorted by these over the cluster and cut into blocks. Within a block each
prefix that starts anew is a candidate; its members are an interval of the sorted order, whose
left and right ends are found apart from each other, by binary search over a sparse table of
minima of the LCPs of neighbours. Candidates stand in preorder, so that what a subtree holds is
a difference of running sums. Nodes that touch an end of their block (prefixes of its
first or last conversation) are put together with those of other blocks in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import cut, table

#: Bytes that stand for a turn.
WIDTH = 16
#: Turns that a block holds at most on average, and at least while cores would idle.
BLOCK_TURNS, FEWEST_TURNS = 200_000, 2_000
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = (
    "block int, side int, at long, depth long, to_end boolean, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,"
    " chars long, parent_conv_id long, parent_side int, ident binary, parent_ident binary, ends string"
)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, chars): the bytes of a conversation's turns and the code points of their texts.

    Turns are in the order of turn (null first), then role, then text; repeated rows are turns of their own.
    A null role or text is empty. Rows without a conv_id belong to no conversation and are left out. Other
    columns don't count.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turn = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * WIDTH)
    numbered = rows.select("conv_id", F.row_number().over(order).alias("no"), turn.alias("h"), F.length("text").alias("chars"))
    turns = numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no", "h", "chars"))).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join("turns.h", "")).alias("key"), F.col("turns.chars").alias("chars"))


def with_shared_heads(sequences: DataFrame) -> DataFrame:
    """Conversations c that begin as c - c % 100 does: with its first crc32(c) % 6 turns in place of their own."""
    c = F.col("conv_id")
    heads = sequences.where("conv_id % 100 = 0").select(c.alias("base"), F.substring("key", 1, 5 * WIDTH).alias("head"), F.slice("chars", 1, 5).alias("head_chars"))
    rows = sequences.withColumns({"base": c - c % 100, "h": (F.crc32(c.cast("string")) % 6).cast("int")}).join(heads, "base", "left")
    return rows.select(
        "conv_id",
        F.expr(f"concat(coalesce(substring(head, 1, {WIDTH} * h), X''), substring(key, {WIDTH} * h + 1))").alias("key"),
        F.expr("concat(coalesce(slice(head_chars, 1, h), array()), slice(chars, h + 1, size(chars)))").alias("chars"),
    )


def common(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of turns that each sequence shares with the one before it; -1 for the first."""
    out = np.full(len(ends), -1, np.int64)
    for i in range(1, len(ends)):
        a, b = ends[i - 2] if i > 1 else 0, ends[i - 1]
        n = min(b - a, ends[i] - b)
        apart = (flat[a : a + n] != flat[b : b + n]).any(axis=1)
        first = int(apart.argmax()) if n else 0
        out[i] = first if n and apart[first] else n
    return out


class Minima:
    """Minima of ranges of an array, from a table of those of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level):
            rows = level == k
            out[rows] = np.minimum(self.levels[k][first[rows]], self.levels[k][last[rows] - (1 << int(k)) + 1])
        return out

    def extent(self, at: np.ndarray, least: np.ndarray, step: int) -> np.ndarray:
        """How far from ``at`` to the right (``step`` 1) or left (-1) all LCPs on the way are at least ``least``.

        The LCP at i is that of entries i - 1 and i, so the way from i to j > i goes over i + 1 to j.
        """
        n, now = len(self.levels[0]), at.copy()
        for k in reversed(range(len(self.levels))):
            leap = 1 << k
            first = now + 1 if step > 0 else now - leap + 1
            inside = (first + leap <= n) if step > 0 else (first >= 1)
            now += np.where(inside & (self.levels[k][np.clip(first, 0, n - leap)] >= least), step * leap, 0)
        return now


def _paths(key: bytes) -> list[bytes]:
    """Hashes of the beginnings of 0, 1, ... turns."""
    h, out = hashlib.sha256(), []
    for a in range(0, len(key) + 1, WIDTH):
        out.append(h.copy().digest())
        h.update(key[a : a + WIDTH])
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a block of conversations sorted by (key, conv_id)."""
    rows = pa.Table.from_batches(found) if (found := [b for b in batches if b.num_rows]) else None
    if rows is None:
        return
    keys, ids = rows["key"].to_pylist(), rows["conv_id"].to_numpy()
    chars = rows["chars"].combine_chunks().flatten().to_numpy()
    lens = np.array([len(k) // WIDTH for k in keys], np.int64)
    ends, m = np.cumsum(lens), len(keys)
    lcp = common(np.frombuffer(b"".join(keys), np.uint64).reshape(-1, WIDTH // 8), ends)
    minima, least_id = Minima(lcp), Minima(ids)
    new = lens - lcp
    start = np.concatenate(([0], np.cumsum(new)))
    at = np.repeat(np.arange(m), new)
    depth = np.arange(start[-1]) - start[at] + lcp[at] + 1
    left, right = minima.extent(at, depth, -1), minima.extent(at, depth, 1)
    up = minima.extent(at, depth - 1, -1)
    parent = np.where(depth > 0, start[up] + depth - 1 - lcp[up] - 1, -1)
    edge = (left == 0) | (right == m - 1)
    side = np.where(left == 0, 0, 1)
    n, after = right - left + 1, start[right + 1]  # what stands before ``after`` from a node on is its subtree
    last = np.concatenate((chars, [0]))[np.where(depth > 0, (ends - lens)[at] + depth - 1, -1)]
    last[depth == 0] = 0
    here = np.arange(len(at))

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(np.where(edge, 0, values))))
        return sums[after] - sums[here]

    inner = ~edge & (parent >= 0)
    children = np.bincount(parent[inner], minlength=len(at))
    least = least_id.of(left, right)
    of_edge = inner & edge[parent]
    same = np.concatenate((np.flatnonzero(~((lcp == lens) & (np.concatenate(([-1], lens[:-1])) == lens))), [m]))  # where runs of equal sequences begin
    run_end = same[np.searchsorted(same, left, "right")]
    ending: list[str | None] = [None] * len(at)
    for c in np.flatnonzero(lens[left] == depth):
        text = ",".join(map(str, ids[left[c] : run_end[c]].tolist()))
        ending[c] = text if edge[c] else hashlib.sha256(text.encode()).hexdigest()
    paths = _paths(keys[0]), _paths(keys[-1])
    ident = [paths[s][d] if e else None for s, d, e in zip(side.tolist(), depth.tolist(), edge.tolist(), strict=True)]
    above = [paths[s][d - 1] if e and d else None for s, d, e in zip(side.tolist(), depth.tolist(), edge.tolist(), strict=True)]
    opt = lambda values, known, kind: pa.array(values, kind, mask=~known)
    columns = {
        "block": pa.array(np.full(len(at), rows["block"][0].as_py(), np.int32)),
        "side": opt(side.astype(np.int32), edge, pa.int32()),
        "at": pa.array(at),
        "depth": pa.array(depth),
        "to_end": pa.array(right == m - 1),
        "conv_id": pa.array(least),
        "n_convs": pa.array(n),
        "n_children": pa.array(children.astype(np.int64)),
        "n_leaves": pa.array(below((after == here + 1).astype(np.int64))),
        "saved_tokens": pa.array(below((n - 1) * last)),
        "chars": pa.array(last.astype(np.int64)),
        "parent_conv_id": opt(least[parent], inner & ~of_edge, pa.int64()),
        "parent_side": opt(side[parent].astype(np.int32), of_edge, pa.int32()),
        "ident": pa.array(ident, pa.binary()),
        "parent_ident": pa.array(above, pa.binary()),
        "ends": pa.array(ending, pa.string()),
    }
    yield from pa.table(columns).to_batches(max_chunksize=10_000)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces of text, which come one after the other."""
    now, h = None, hashlib.sha256()
    for batch in batches:
        done = []
        for ident, text in zip(batch["ident"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if ident != now:
                if now is not None:
                    done.append((now, h.hexdigest()))
                now, h = ident, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done])], ["ident", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["ident", "ends_sha256"])


def _merged(parts: DataFrame) -> DataFrame:
    """The nodes that touch ends of blocks, from their parts; (ident, ...) as the result, and first block.

    A node's subtree holds nodes within blocks, counted there, and nodes of this kind. The latter
    follow it in preorder: by the block and place where they start, and depth. Running sums within the block they start in,
    and those over blocks (a row a block), give their part.
    """
    nodes = parts.groupBy("ident").agg(
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        *[F.first(c).alias(c) for c in ("depth", "chars", "parent_ident")],
        F.min("conv_id").alias("conv_id"), F.min(F.struct("block", "at")).alias("first"), F.max(F.struct("block", "to_end")).alias("last"),
    )
    inside = nodes.groupBy(F.col("parent_ident").alias("ident")).agg(F.count("*").alias("more")).where("ident IS NOT NULL")
    nodes = nodes.join(inside, "ident", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = cut(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars"), "block": F.col("first.block"), "at": F.col("first.at")}))
    values = ("leaf", "saved")
    so_far = Window.partitionBy("block").orderBy("at", "depth").rowsBetween(Window.unboundedPreceding, -1)
    running = nodes.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(so_far), F.lit(0)) for v in values})
    totals = nodes.groupBy("block").agg(*[F.sum(v).alias(f"{v}_all") for v in values], *[F.sum(F.when(F.col("at") == 0, F.col(v)).otherwise(0)).alias(f"{v}_first") for v in values])
    blocks = parts.select("block").distinct().join(totals, "block", "left").fillna(0)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = cut(blocks.withColumns({f"{v}_earlier": F.coalesce(F.sum(f"{v}_all").over(earlier), F.lit(0)) for v in values}))
    begins = blocks.select("block", *[F.col(f"{v}_earlier").alias(f"{v}_begin") for v in values])
    closes = blocks.select(F.col("block").alias("last_block"), *[f"{v}_{x}" for v in values for x in ("all", "first", "earlier")])
    whole = running.withColumn("last_block", F.col("last.block")).join(begins, "block").join(closes, "last_block")
    part = {v: F.col(f"{v}_earlier") + F.when(F.col("last.to_end"), F.col(f"{v}_all")).otherwise(F.col(f"{v}_first")) - F.col(f"{v}_begin") - F.col(f"{v}_before") for v in values}
    whole = whole.withColumns({"n_leaves": F.col("n_leaves") + part["leaf"], "saved_tokens": F.col("saved_tokens") + part["saved"]})
    parents = nodes.select(F.col("ident").alias("parent_ident"), F.col("conv_id").alias("parent_conv_id"))
    pieces = parts.where("ends IS NOT NULL").select("ident", "block", "ends").repartition("ident").sortWithinPartitions("ident", "block")
    whole = whole.join(parents, "parent_ident", "left").join(pieces.mapInArrow(_hashed, "ident binary, ends_sha256 string"), "ident", "left")
    return whole.select("ident", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(sequences: DataFrame, block_turns: int = BLOCK_TURNS, fewest: int = FEWEST_TURNS) -> DataFrame:
    """Every distinct beginning of ``sequences`` (conv_id, key, chars) as a node; no rows without sequences.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). A
    sequence's bytes have to fit one row, 2 GB. Groups of equal sequences or beginnings of any size are
    spread over blocks, as the order goes on by conv_id.
    """
    sequences = cut(sequences)
    total = sequences.agg(F.sum(F.size("chars")) + F.count("*")).first()[0] or 0
    n = max(1, -(-total // block_turns), min(sequences.sparkSession.sparkContext.defaultParallelism, -(-total // fewest)))
    blocks = sequences.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("block", F.spark_partition_id())
    found = cut(blocks.mapInArrow(_nodes, SCHEMA))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parts = found.where("side IS NOT NULL")
    merged = _merged(parts)
    above = parts.select("block", "side", "depth", "ident").join(merged.select("ident", F.col("conv_id").alias("edge_conv_id")), "ident")
    above = above.select(F.col("block"), F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "edge_conv_id")
    inner = found.where("side IS NULL").withColumn("ends_sha256", F.col("ends"))
    own = inner.where("parent_side IS NULL")
    others = inner.where("parent_side IS NOT NULL").join(above, ["block", "parent_side", "depth"]).withColumn("parent_conv_id", F.col("edge_conv_id"))
    return own.select(out).union(others.select(out)).union(merged.select(out)).fillna(EMPTY, ["ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    return trie(sequences(conversations))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with the head that the contract gives it."""
    return trie(with_shared_heads(cut(sequences(table(spark, sf_dir, "conversations")))))


# crc32 by its definition: a byte at a time, a bit at a time, the reflected polynomial 0xEDB88320
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda b: ascii(b)::BIGINT)), lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT)"
SQL = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, {CRC} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c.c, t.no, t.role, t.text FROM c JOIN t ON t.c = c.c - c.c % 100 AND no <= h UNION ALL SELECT c.c, t.no, t.role, t.text FROM c JOIN t ON t.c = c.c AND no > h),
s AS (SELECT c.c, coalesce(list(sha256(strlen(role) || ':' || role || text) ORDER BY no) FILTER (no IS NOT NULL), []) AS turns, coalesce(list(length(text) ORDER BY no) FILTER (no IS NOT NULL), []) AS chars FROM c LEFT JOIN r ON r.c = c.c GROUP BY c.c),
p AS (SELECT c, d, array_to_string(turns[1:d], '') AS k, array_to_string(turns[1:d-1], '') AS up, len(turns) AS n, coalesce(chars[d], 0) AS chars FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM s)),
g AS (SELECT d, k, min(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * min(chars) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY d, k),
ch AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL),
f AS (SELECT g.*, coalesce(ch.n, 0) AS children FROM g LEFT JOIN ch ON ch.d = g.d AND ch.k = g.k),
su AS (SELECT a.d, a.k, sum(f.saved)::BIGINT AS saved, sum((f.children = 0)::INT)::BIGINT AS leaves FROM f JOIN p a ON a.c = f.c AND a.d <= f.d GROUP BY ALL)
SELECT f.c::BIGINT AS conv_id, f.d::BIGINT AS depth, CASE WHEN f.d > 0 THEN pa.c END::BIGINT AS parent_conv_id, f.n::BIGINT AS n_convs, f.children::BIGINT AS n_children, su.leaves AS n_leaves, su.saved AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN su ON su.d = f.d AND su.k = f.k LEFT JOIN g pa ON pa.d = f.d - 1 AND pa.k = f.up"""
