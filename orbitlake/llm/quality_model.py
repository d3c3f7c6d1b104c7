"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed where the texts are, one Arrow batch at a time.
Trees are grown on histograms of binned statistics, from a bounded sample of the
labelled rows (FIT_ROWS, lowest hashes first); the learner sees nothing but statistics.
A fitted forest is six flat arrays, and scoring walks all rows of a batch down a tree
at a time, a level a step, without a Python loop over rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm.common import arrow_in_small_batches, cut, if_small, table

#: Labelled rows that a fit takes at most: 20,000 of 16 numbers are 2.5 MB on the driver.
FIT_ROWS = 20_000
STATISTICS = "words distinct word_length symbols upper digits calls stops lines repeated_lines line_words long_words short_words non_ascii repeated_pairs top_word".split()
SYMBOL = re.compile(r"[#*$%&|<>{}\[\]~^=\\@_]")
UPPER, DIGIT, CALL, STOP = re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[!?]"), re.compile(r"[.,;:]")


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; zeros for null and blank ones."""
    text = text or ""
    w = text.split()
    if not w:
        return [0.0] * len(STATISTICS)
    n, chars = len(w), len(text)
    lengths = np.fromiter(map(len, w), np.int64, n)
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, n)
    pairs = codes[:-1] * len(ids) + codes[1:]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return [
        np.log1p(n),
        len(ids) / n,
        lengths.mean(),
        len(SYMBOL.findall(text)) / n,
        len(UPPER.findall(text)) / chars,
        len(DIGIT.findall(text)) / chars,
        len(CALL.findall(text)) / n,
        len(STOP.findall(text)) / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        (lengths > 12).mean(),
        (lengths < 3).mean(),
        (len(text.encode("utf-8", "surrogatepass")) - chars) / chars,
        1 - len(np.unique(pairs)) / max(1, n - 1) if n > 1 else 0.0,
        np.bincount(codes).max() / n,
    ]


@dataclass
class Forest:
    """Nodes of all trees in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Forest:
    """Boosted trees for labels 0 and 1 by logistic loss; a constant if there is one class only or no rows."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    feature, limit, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (limit, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    score = np.full(len(y), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(STATISTICS))]
    codes = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]  # code <= i exactly where x <= cuts[i]
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        open_ = [(root, np.arange(len(y)), 0)]
        while open_:
            at, rows, level = open_.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            if level < depth and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = codes[f][rows]
                    gl, hl, nl = (np.cumsum(np.bincount(k, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], f, i)
            if best[1] is None:
                value[at] = -rate * gs / (hs + ridge)
                score[rows] += value[at]
                continue
            f, i = best[1:]
            goes = codes[f][rows] <= i
            feature[at], limit[at], left[at], right[at] = f, cuts[f][i], node(), node()
            open_ += [(left[at], rows[goes], level + 1), (right[at], rows[~goes], level + 1)]
    return Forest(np.array(feature, int), np.array(limit, float), np.array(left, int), np.array(right, int), np.array(value, float), np.array(roots, int), depth, base)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Fits to the quality of at most ``rows`` labelled documents; rows without a label are left out."""
    arrow_in_small_batches(docs.sparkSession)
    chosen = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    chosen = cut(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows))
    texts = docs.select("doc_id", "text").join(if_small(chosen, rows), "doc_id").select("doc_id", "text")
    x = texts.mapInArrow(_statistics, "doc_id long, x array<double>")
    found = x.join(if_small(chosen, rows), "doc_id").orderBy("doc_id", "quality").limit(rows).toArrow()
    values = np.array(found.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit(values, np.array(found.column("quality").to_pylist(), float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) for every row of ``docs``: the probability of label 1, also of null and empty texts."""
    arrow_in_small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.predict(x))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of the held-out fifth are not used."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    forest = learn(docs.where(~held_out(0)), labels.where(~held_out(0)))
    out = score(docs, forest)
    return out.select("doc_id", held_out(0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
