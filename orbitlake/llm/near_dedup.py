"""MinHash near-duplicates with tensored banding.

A pair of documents should meet in a table if ``rows`` minhashes agree. Instead of
computing fresh minhashes for each of T tables, two collections of sqrt(T) short
sketches are computed (``half`` minhashes each), and a table's key joins one sketch of
either collection (Christiani, "Fast locality-sensitive hashing frameworks", 2019). With
half = 3 and 12 sketches a collection, 72 minhashes serve 144 tables of 6 rows; at
similarity 0.8 a pair meets with probability (1 - (1 - 0.8 ** 3) ** 12) ** 2 = 0.9996.

Documents with equal shingle sets form a class that takes part once. Within a bucket
the smallest class is linked to all others and each class to the next, never all to
all; then, for buckets whose members still lie in different components, the pairs
between components (only those can join anything) are listed. Candidates are looked at
through two small sketches first. An odd sketch (Mitzenmacher, Pagh and Pham, "Efficient
estimation for high similarities using odd sketches", 2014) keeps the parity of 256 bins;
bins that differ never outnumber the shingles that differ, so that it rules out no link.
One bit of each of 256 one-permutation minhashes (Li, Owen and Zhang, "One permutation
hashing", 2012) serves for long texts; it rules out a pair at the threshold about once in
a million. All other pairs are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import WordHashes, arrow_in_small_batches, cut, if_small, mix64, shuffles_go, table
from orbitlake.operators.graph import connected_components

HALF, SKETCHES = 3, 12
#: Longs that hold one bit for each of 256 bins.
LONGS = 4


def shingle_sets(texts: pa.Array, k: int, read: WordHashes) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of all words if there are fewer; none without words."""
    h, at = read(texts)
    n = np.diff(at)
    s = np.zeros(len(h), np.uint64)
    for i in range(k):
        s[: len(h) - i] = mix64(s[: len(h) - i] + h[i:] * np.uint64(2 * i + 0x9E3779B97F4A7C15))
    s += np.uint64(k)
    sets = []
    for a, m in zip(at.tolist(), n.tolist()):
        if m >= k:
            x = s[a : a + m - k + 1]
        else:
            x = mix64(np.array([int((h[a : a + m] * np.arange(1, 2 * m, 2, dtype=np.uint64)).sum()) + m & (1 << 64) - 1] * (m > 0), np.uint64))
        x = np.sort(x)
        sets.append(x[np.append(True, x[1:] != x[:-1])] if len(x) else x)
    return sets


def _multipliers() -> np.ndarray:
    """Two odd 32-bit multipliers for each minhash."""
    n = 2 * SKETCHES * HALF
    return np.random.default_rng(20240229).integers(0, 1 << 31, (2, n), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def sketches(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For sets laid end to end, none empty: 2 * SKETCHES hashes a set, each of HALF minhashes."""
    a, b = _multipliers()
    x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    y, z = np.empty_like(x), np.empty_like(x)
    low = np.empty((len(a), len(starts)), np.uint32)
    for j in range(len(a)):
        np.multiply(x, a[j], out=y)
        np.right_shift(y, np.uint32(15), out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, b[j], out=y)
        low[j] = np.minimum.reduceat(y, starts)
    low = low.T.reshape(len(starts), -1, HALF).astype(np.uint64)
    out = np.zeros(low.shape[:2], np.uint64)
    for i in range(HALF):
        out = mix64(out * np.uint64(31) + low[:, :, i])
    return out


def _runs(sizes: list[int], most: int = 24_576) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring sets, ``most`` hashes or one set at a time, which keeps arrays in the cache."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if sizes:
        yield first, len(sizes)


def glance(sets: np.ndarray) -> np.ndarray:
    """LONGS longs with a bit of the smallest hash of each bin, LONGS that mark bins with a hash, LONGS with the parity of other bins, and the set's size."""
    y = np.sort(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)))
    top = (y >> np.uint64(56)).astype(np.uint8)
    at = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    bits = np.zeros((3, 64 * LONGS), bool)
    bits[0, top[at]] = (y[at] & np.uint64(1)).astype(bool)
    bits[1, top[at]] = True
    other = ((y >> np.uint64(8)) & np.uint64(64 * LONGS - 1)).astype(np.int64)
    bits[2] = np.bincount(other, minlength=64 * LONGS) & 1
    return np.concatenate((np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel(), [len(sets)]))


def _may_link(x: str, y: str, percent: int) -> Column:
    """False if the glances in columns ``x`` and ``y`` show more differences than linked documents have.

    Parities that differ are at most the shingles that differ. A bin with a hash in either
    set differs at the rate of 1 - similarity, and shows it in its bit half of the time, so
    that differing bits count twice; 5.5 deviations are granted.
    """
    x, y = F.col(x), F.col(y)
    at = range(LONGS)
    odd = sum(F.bit_count(x[2 * LONGS + i].bitwiseXOR(y[2 * LONGS + i])) for i in at)
    marks = [(x[LONGS + i], y[LONGS + i]) for i in at]
    either = sum(F.bit_count(p.bitwiseOR(q)) for p, q in marks)
    one = sum(F.bit_count(p.bitwiseXOR(q)) for p, q in marks)
    bits = sum(F.bit_count(x[i].bitwiseXOR(y[i]).bitwiseAND(p).bitwiseAND(q)) for i, (p, q) in zip(at, marks, strict=True))
    far = 1 - percent / 100
    alike = (100 + percent) * odd <= (100 - percent) * (x[3 * LONGS] + y[3 * LONGS])
    return alike & (2 * bits + one <= far * either + 5.5 * F.sqrt((2 * far - far * far) * either) + 3)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, read = pa.list_(pa.int64()), WordHashes(lower=True)
        for batch in batches:
            sets = shingle_sets(batch.column(1), k, read)
            full = [i for i, x in enumerate(sets) if len(x)]
            s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            none: np.ndarray = np.zeros(0, np.int64)
            a, b, g = ([none] * len(sets) for _ in range(3))
            for first, end in _runs([len(sets[i]) for i in full]):
                at = full[first:end]
                flat = np.concatenate([sets[i] for i in at])
                starts = np.cumsum([0, *[len(sets[i]) for i in at[:-1]]])
                s1[at] = np.add.reduceat(mix64(flat), starts)
                s2[at] = np.bitwise_xor.reduceat(mix64(flat + np.uint64(77)), starts)
                for i, both in zip(at, sketches(flat, starts).view(np.int64), strict=True):
                    a[i], b[i], g[i] = both[:SKETCHES], both[SKETCHES:], glance(sets[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(a, longs), pa.array(b, longs), pa.array(g, longs)],
                names=["doc_id", "n", "s1", "s2", "a", "b", "g"],
            )

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = WordHashes(lower=True)
        for batch in batches:
            yes = []
            for left, right in zip(shingle_sets(batch.column(2), k, read), shingle_sets(batch.column(3), k, read), strict=True):
                both = len(left) + len(right) - len(np.union1d(left, right))
                yes.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return run


def _links(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose documents' full sets are similar enough.

    Only texts that a pair asks for are shuffled.
    """
    pairs = cut(pairs)
    asked = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = docs.select("doc_id", "text").join(if_small(asked, 2_000_000), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_confirm(k, percent), "a long, b long")


@shuffles_go
def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Documents are linked if ``100 * |both| >= percent * |either|`` over their sets of k-word
    shingles in lower case (A-Z); component_id is the smallest doc_id reachable. A null or
    blank text has an empty set and is linked with nothing. Rows that repeat a doc_id are
    one document, whose smallest text counts where links are confirmed. A row without a
    doc_id links nothing: its component_id is that of rows with the same set that have one, else null.
    """
    arrow_in_small_batches(docs.sparkSession)
    found = cut(docs.select("doc_id", "text").mapInArrow(_sketch(k), "doc_id long, n long, s1 long, s2 long, a array<long>, b array<long>, g array<long>"))
    kinds = found.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "a", "b", "g")).alias("first"))
    kinds = cut(kinds.select("n", "s1", "s2", F.col("first.doc_id").alias("rep"), F.col("first.a").alias("a"), F.col("first.b").alias("b"), F.col("first.g").alias("g")))
    glances = kinds.select("rep", "g")
    halves = kinds.select("rep", "n", "b", F.posexplode("a").alias("i", "x"))
    keyed = halves.select("rep", "n", "i", "x", F.posexplode("b").alias("j", "y")).select(F.xxhash64("i", "x", "j", "y").alias("key"), "rep", "n", (F.col("i") * SKETCHES + F.col("j")).cast("short").alias("t"))
    bucket = Window.partitionBy("key").orderBy("rep")
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prior = F.lag(F.struct("rep", "n")).over(bucket)
    first = F.first(F.struct("rep", "n")).over(bucket)
    near = keyed.withColumns({"prior": prior, "first": first, "members": F.count("*").over(whole)}).where("members > 1")
    near = cut(near.select("key", "rep", "n", "t", "prior", "first", "members").where("members > 3 or prior is not null"))
    ends = near.where("prior is not null").select("rep", "n", F.explode(F.array_distinct(F.array("first", "prior"))).alias("other"))
    ratio = 100 * F.least(F.col("n"), F.col("other.n")) >= percent * F.greatest(F.col("n"), F.col("other.n"))
    tried = ends.where(ratio).select(F.col("other.rep").alias("a"), F.col("rep").alias("b")).where("a < b").distinct()
    tried = tried.join(glances.toDF("a", "x"), "a").join(glances.toDF("b", "y"), "b")
    tried = cut(tried.where(_may_link("x", "y", percent)).select("a", "b"))
    links = cut(_links(tried, docs, k, percent))
    parts = cut(connected_components(links))

    # buckets of four and more may hold pairs that neither the first nor a neighbour stood for
    open_ = near.where("members > 3").select("key", "rep", "n", "t").join(if_small(parts.withColumnRenamed("node", "rep")), "rep", "left")
    open_ = open_.withColumn("part", F.coalesce("component", "rep")).drop("component")
    mixed = open_.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    open_ = cut(open_.join(mixed, "key").join(kinds.select("rep", "a", "b", "g"), "rep").select("key", "rep", "n", "t", "part", "a", "b", "g"))
    l, r = open_.alias("l"), open_.alias("r")
    across = (F.col("l.key") == F.col("r.key")) & (F.col("l.rep") < F.col("r.rep")) & (F.col("l.part") != F.col("r.part"))
    across &= 100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")
    across &= _may_link("l.g", "r.g", percent)
    for half, at in (("a", F.floor(F.col("l.t") / SKETCHES)), ("b", F.col("l.t") % SKETCHES)):  # a pair comes from the first of the tables in which it meets
        equal = F.zip_with(f"l.{half}", f"r.{half}", lambda x, y: x == y)
        across &= F.array_position(equal, True) == at + 1
    more = l.join(r, across).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = cut(_links(more, docs, k, percent))
    if not more.isEmpty():
        parts = cut(connected_components(links.union(more)))
    kinds = kinds.select("n", "s1", "s2", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    kinds = cut(kinds.select("n", "s1", "s2", F.coalesce("component", "rep").alias("component")))
    rows = found.select("doc_id", "n", "s1", "s2").join(kinds, ["n", "s1", "s2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


@shuffles_go
def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` (doc_id, text and any others) for each group: that of the smallest doc_id.

    Documents without words, or without a doc_id, stay. Where rows repeat a doc_id, one of them stays.
    """
    found = near_duplicates(docs, k, percent)
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(if_small(gone, 2_000_000), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = cut(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    again = if_small(again)
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents by 2-word shingles at 0.8; a row without a doc_id is kept if no row with one has its set."""
    out = near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
