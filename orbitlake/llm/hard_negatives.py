"""Hard negatives of anchors among all vectors, by bounds along spanning trees of the anchors.

Anchors are dealt into blocks, and each block gets a minimum spanning tree. A candidate x with
score s at an anchor has a score within s - d |x| and s + d |x| at a child at distance d, so
that only candidates whose bounds meet the child's window of scores are scored there; all others
hand the wider bounds on. Windows narrow as better candidates are found.

Two passes: the nearest rows of an anchor's own label, then per such positive the best rows of
other labels whose score lies in a band below the positive's. A pass deals the candidates
of each block over cells, keeps the best of each cell and merges these in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import cut, table

#: Anchors of a block on average, candidates that are bounded at a time, and the fewest candidates that a cell is worth.
ANCHORS_A_BLOCK, CHUNK, FEWEST = 4096, 1024, 2000
#: Added to bounds for what rounding takes from them: as it is, a share of the edge, and a share of the largest possible score.
SLACK, OF_EDGE, OF_SCORE = 1e-6, 1e-9, 1e-12
EXACT = 2.0**53
NONE = np.zeros(0, np.int64)


def matrix(vectors: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of numbers, shorter ones filled up with zeros; columns past ``dim`` left out."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lens = vectors.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lens.max(initial=0)) if dim is None else dim
    if len(lens) and (lens == lens[0]).all():
        found = flat.reshape(len(lens), -1)[:, :width]
        if found.shape[1] == width:
            return found.astype(np.float64)
    out = np.zeros((len(lens), width))
    row = np.repeat(np.arange(len(lens)), lens)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[row[column < width], column[column < width]] = flat[column < width]
    return out


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parents, edge lengths) of a minimum spanning tree of the rows, by Prim's method; the root is row 0, its parent -1, its edge its length."""
    n, square = len(x), (x * x).sum(axis=1)
    parent, best = np.full(n, -1), np.full(n, np.inf)
    length, out = np.sqrt(square), np.zeros(n, bool)
    now = 0
    for _ in range(n - 1):
        out[now] = True
        away = np.maximum(0, square + square[now] - 2 * (x @ x[now]))
        nearer = ~out & (away < best)
        best[nearer], parent[nearer] = away[nearer], now
        now = int(np.where(out, np.inf, best).argmin())
        length[now] = np.linalg.norm(x[now] - x[parent[now]])
    return parent, length


def _tree(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("vec_id", "ascending"), ("label", "ascending")]).combine_chunks()
    parent, length = spanning_tree(matrix(rows["q"].combine_chunks()))
    return rows.append_column("no", pa.array(np.arange(len(rows)))).append_column("parent", pa.array(parent.astype(np.int64))).append_column("edge", pa.array(length))


class Best:
    """The first ``k`` of (score, id) seen within [low, high]: higher scores first, ties to the smaller id."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high, self.scores, self.ids = k, low, high, NONE, NONE

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.low) & (scores <= self.high)
        if fits.any():
            s, i = np.concatenate((self.scores, scores[fits])), np.concatenate((self.ids, ids[fits]))
            order = np.lexsort((i, -s))[: self.k]
            self.scores, self.ids = s[order], i[order]
            if len(order) == self.k:
                self.low = max(self.low, int(self.scores[-1]))


class Block:
    """Anchors of a block in preorder of their tree, with what each looks for: a Best or more, among its own label or all others."""

    def __init__(self, rows: pa.Table, wanted: Callable[[list[int]], list[Best]], same_label: bool):
        self.x = matrix(rows["q"].combine_chunks())
        self.ids, self.labels, self.no = (rows[c].to_numpy() for c in ("vec_id", "label", "no"))
        self.parent, self.edge = rows["parent"].to_numpy(), rows["edge"].to_numpy()
        self.same, self.found = same_label, [wanted(w or []) for w in rows["positives"].to_pylist()]
        self.most, self.scored, self.seen = float(np.abs(self.x).max(initial=0)), 0, 0
        self.reach = self.edge * (1 + OF_EDGE) + OF_SCORE * np.linalg.norm(self.x, axis=1).max(initial=0)
        children: list[list[int]] = [[] for _ in self.no]
        for c, p in enumerate(self.parent.tolist()):
            if p >= 0:
                children[p].append(c)
        self.left, self.order, stack = [len(c) for c in children], [], [0]
        while stack:
            self.order.append(stack.pop())
            stack += children[self.order[-1]]

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        norm = np.sqrt((x * x).sum(axis=1))
        exact = self.most * float(np.abs(x).max(initial=0)) * x.shape[1] < EXACT
        whole = x if exact else x.astype(np.int64)
        bounds, left = {}, list(self.left)
        for c in self.order:
            p, reach = self.parent[c], self.reach[c] * norm + SLACK
            low, high = (bounds[p][0] - reach, bounds[p][1] + reach) if p >= 0 else (-reach, reach)
            if p >= 0:
                left[p] -= 1
                if not left[p]:
                    del bounds[p]
            found = self.found[c]
            if found:
                meets = (high >= min(f.low for f in found)) & (low <= max(f.high for f in found))
                meets &= (labels == self.labels[c]) & (ids != self.ids[c]) if self.same else labels != self.labels[c]
                at = np.flatnonzero(meets)
                s = whole[at] @ (self.x[c] if exact else self.x[c].astype(np.int64))
                low[at] = high[at] = s
                s = s.astype(np.int64)
                for f in found:
                    f.add(s, ids[at])
                self.scored += len(at)
            if left[c]:
                bounds[c] = low, high
        self.seen += len(ids) * len(self.order)

    def result(self, block: int) -> pa.RecordBatch:
        rows = [(self.no[c], r, f) for c, found in enumerate(self.found) for r, f in enumerate(found) if len(f.ids)]
        n = [len(f.ids) for _, _, f in rows]
        columns = [np.full(sum(n), block), np.repeat([x for x, _, _ in rows], n), np.repeat([x for _, x, _ in rows], n)]
        columns += [np.concatenate([NONE, *(f.ids for _, _, f in rows)]), np.concatenate([NONE, *(f.scores for _, _, f in rows)])]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["block", "no", "of", "vec_id", "score"])


def _cells(wanted: Callable[[list[int]], list[Best]], same_label: bool, cells: int):
    """What the cells of a partition find: the rows of a cell come together, its anchors before its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, block = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            cell, is_anchor = rows["cell"].to_numpy(), rows["parent"].is_valid().to_numpy()
            breaks = np.flatnonzero((np.diff(cell) != 0) | (np.diff(is_anchor.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *breaks], [*breaks, len(cell)], strict=True):
                if cell[a] != now:
                    if block:
                        yield block.result(now // cells)
                    now, anchors, block = cell[a], [], None
                part = rows.slice(a, b - a)
                if is_anchor[a]:
                    anchors.append(part)
                    continue
                block = block or Block(pa.concat_tables(anchors).combine_chunks(), wanted, same_label)
                for i in range(0, len(part), CHUNK):
                    some = part.slice(i, CHUNK)
                    block.meet(some["vec_id"].to_numpy(), some["label"].to_numpy(), matrix(some["q"].combine_chunks(), block.x.shape[1]))
        if block:
            yield block.result(now // cells)

    return run


def _met(anchors: DataFrame, candidates: DataFrame, blocks: int, wanted: Callable[[list[int]], list[Best]], same_label: bool) -> DataFrame:
    """(block, no, of, vec_id, score): the best of each cell, by anchor and place of what it looks for."""
    idle = candidates.sparkSession.sparkContext.defaultParallelism
    cells = max(1, min(-(-2 * idle // blocks), -(-candidates.count() // FEWEST)))
    part = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    left = anchors.withColumn("part", part).select((F.col("block") * cells + F.col("part")).alias("cell"), "no", "vec_id", "label", "q", "parent", "edge", "positives")
    right = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select((F.col("block") * cells + F.pmod(F.xxhash64("vec_id"), F.lit(cells))).alias("cell"), "vec_id", "label", "q")
    every = left.unionByName(right, allowMissingColumns=True)
    dealt = every.repartition(blocks * cells, "cell").sortWithinPartitions("cell", F.asc_nulls_last("no"))
    return dealt.mapInArrow(_cells(wanted, same_label, cells), "block long, no long, of long, vec_id long, score long")


def whole_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: with an id, a label and a vector, all of whose components are finite numbers.

    q is floor(scale * x) for each component x, as 32-bit integers; a component beyond that fails the
    job. Other columns don't count.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").dropna()
    rows = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int")).alias("q"))


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of the anchors, the rows of ``vectors`` (vec_id, label, q) whose vec_id is divisible by ``every``.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of an
    anchor's best ``positives`` rows of its label, the best ``negatives`` rows of other labels whose score is
    ``low`` to ``high`` percent of the positive's. Scores are inner products, missing components zero; ties go to the smaller
    vec_id. Rows that repeat a vec_id are rows of their own, except that equal anchors are one and that no row is a
    positive of an anchor with its vec_id.
    """
    vectors = cut(vectors)
    chosen = vectors.where(F.col("vec_id") % every == 0).distinct()
    blocks = max(1, -(-chosen.count() // ANCHORS_A_BLOCK))
    dealt = chosen.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    anchors = cut(dealt.groupBy("block").applyInArrow(_tree, "vec_id long, label long, q array<int>, block long, no long, parent long, edge double"))
    near = _met(anchors.withColumn("positives", F.lit(None).cast("array<long>")), vectors, blocks, lambda _: [Best(positives)], True)
    place = F.row_number().over(Window.partitionBy("block", "no").orderBy(F.desc("score"), "vec_id"))
    near = cut(near.withColumn("of", place - 1).where(F.col("of") < positives))
    lists = near.groupBy("block", "no").agg(F.array_sort(F.collect_list(F.struct("of", "score"))).alias("p")).select("block", "no", F.col("p.score").alias("positives"))

    def bands(scores: list[int]) -> list[Best]:
        return [Best(negatives, -(-low * p // 100), high * p // 100) for p in scores]

    far = _met(anchors.join(lists, ["block", "no"], "left"), vectors, blocks, bands, False)
    rank = F.row_number().over(Window.partitionBy("block", "no", "of").orderBy(F.desc("score"), "vec_id"))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives).select("block", "no", "of", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select("block", "no", F.col("vec_id").alias("anchor_id"))
    pairs = near.select("block", "no", "of", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, ["block", "no"])
    return pairs.join(far, ["block", "no", "of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives in ``embeddings``, labels of every seventh row changed as the contract has it."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(whole_vectors(rows.withColumn("label", label)))


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, v.vec_id AS b, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS s FROM v a JOIN v ON a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INT AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s QUALIFY rank <= 10"""
