"""Substring dedup by seed and extend.

Seeds: of every SPAN words, the 7-word gram with the smallest hash is an anchor
(winnowing, Schleimer et al. 2003). Which one that is depends on those SPAN words alone,
so wherever a run of SPAN words occurs again, its anchor does too. Anchors are shuffled by hash;
those of one document only are dropped.

Extend: around the anchors that are left, matches are extended to both sides, at most
SPAN - 7 words each way: a match that holds an anchor at the same place holds each window of SPAN
words that chose it. The smallest doc_id that holds a window is found by the window's
64-bit hash (words are not compared again). Windows found in a smaller document merge into
maximal repeats, which go.

Documents with equal texts take part once: of at least SPAN words, all but the first lose
everything. Neither an anchor's nor a window's occurrences are ever paired with each other.
Occurrences of most anchors are looked at within their hash's task; those of anchors with at
least one occurrence in HOT, and the windows around them, are aggregated before they are
shuffled, and the smallest doc_id is joined back.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import WordHashes, arrow_in_small_batches, cut, if_small, mix64, ragged, shared_folder, table

SPAN, GRAM = 13, 7
#: An anchor with one occurrence in so many is treated as frequent: there are at most HOT of them.
HOT = 1000


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k entries."""
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        s = mix64(s + h[i : i + len(s)] * np.uint64(2 * i + 0x9E3779B97F4A7C15))
    return s


def anchors(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of 7-word grams, starts of windows, for each the start of the gram it chooses: the first of the smallest).

    ``h`` has the words of texts end to end, ``ends`` for each word the end of its text.
    """
    g = _rolling(h, GRAM)
    n = max(0, len(h) - SPAN + 1)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, SPAN - GRAM + 1):
        x = g[i : i + n]
        less = x < best
        best[less] = x[less]
        at[less] = i
    starts = np.flatnonzero(np.arange(n) + SPAN <= ends[:n])
    return g, starts, at[starts] + starts


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack, read = zstandard.ZstdCompressor(level=1), WordHashes(lower=False)
    for batch in batches:
        h, at = read(batch.column(1))
        n = np.diff(at)
        g, starts, chosen = anchors(h, np.repeat(at[1:], n))
        cuts = np.searchsorted(starts, at)
        sha, key, packed, seeds = [], [], [], []
        for i, text in enumerate(batch.column(1)):
            whole = b" ".join((text.as_py() or "").encode("utf-8", "surrogatepass").split())
            digest = hashlib.sha256(whole)
            sha.append(digest.hexdigest())
            key.append(int.from_bytes(digest.digest()[:8], "big", signed=True))
            packed.append(pack.compress(whole))
            seeds.append(np.unique(g[chosen[cuts[i] : cuts[i + 1]]]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(key, pa.int64()), pa.array(packed, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))],
            names=["doc_id", "n_words", "sha", "key", "packed", "seeds"],
        )


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that chose one of the document's given anchors: hashes and, for each, its first start."""
    unpack, read = zstandard.ZstdDecompressor(), WordHashes(lower=False)
    for batch in batches:
        h, at = read(pa.array([unpack.decompress(x.as_py()) for x in batch.column(2)], pa.binary()))
        g, starts, chosen = anchors(h, np.repeat(at[1:], np.diff(at)))
        cuts = np.searchsorted(starts, at)
        asked = np.zeros(len(starts), bool)
        for i, seeds in enumerate(batch.column(3)):
            here = slice(cuts[i], cuts[i + 1])
            asked[here] = np.isin(g[chosen[here]], np.asarray(seeds.values).astype(np.int64).view(np.uint64))
        found = starts[asked]
        texts = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(found, at)))
        windows = _rolling(h, SPAN)[found]
        order = np.lexsort((found, windows, texts))
        found, texts, windows = found[order], texts[order], windows[order].view(np.int64)
        first = np.append(True, (windows[1:] != windows[:-1]) | (texts[1:] != texts[:-1]))[: len(found)]
        found, texts, windows = found[first], texts[first], windows[first]
        sizes = np.searchsorted(texts, np.arange(len(at)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ragged(windows, sizes), ragged((found - at[texts]).astype(np.int32), sizes)], names=["doc_id", "key", "h", "at"])


def repeats(starts: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words that windows at ``starts`` cover."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + SPAN, n), -1)
    return np.cumsum(edges[:n]) > 0


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the words of all windows that are equal to those at the given starts."""
    unpack, read = zstandard.ZstdDecompressor(), WordHashes(lower=False)
    for batch in batches:
        texts, removed, kept = [unpack.decompress(x.as_py()) for x in batch.column(2)], [], []
        h, at = read(pa.array(texts, pa.binary()))
        for i, starts in enumerate(batch.column(3)):
            w = texts[i].split()
            windows = _rolling(h[at[i] : at[i + 1]], SPAN)
            gone = repeats(np.flatnonzero(np.isin(windows, windows[np.asarray(starts.values).astype(np.int64)])), len(w))
            removed.append(int(gone.sum()))
            kept.append(b" ".join(x for x, d in zip(w, gone.tolist(), strict=True) if not d).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "key", "n_removed", "kept"])


def _frequent(seeds: DataFrame) -> DataFrame:
    """The anchors with at least one in HOT occurrences, as far as a sketch shows (results don't hang on it)."""
    top = seeds.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(seed, {HOT}, {10 * HOT})").alias("top"))
    return cut(top.select("n", F.explode("top").alias("t")).where(F.col("t.count") * HOT >= F.col("n")).select(F.col("t.item").alias("seed")))


def _lowest(rows: DataFrame, by: str, frequent: DataFrame | None) -> DataFrame:
    """``rows`` with lo and hi, the smallest and largest doc_id of their ``by``."""
    least = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")]
    if frequent is None:
        at = Window.partitionBy(by)
        return rows.withColumns({"lo": F.min("doc_id").over(at), "hi": F.max("doc_id").over(at)})
    rare = _lowest(rows.join(F.broadcast(frequent), by, "left_anti"), by, None)
    often = rows.join(F.broadcast(frequent), by, "left_semi")
    return rare.unionByName(often.join(F.broadcast(often.groupBy(by).agg(*least)), by))  # at most HOT values


def _windows(texts: DataFrame) -> DataFrame:
    found = texts.select("doc_id", "key", "packed", "seeds").mapInArrow(_extend, "doc_id long, key long, h array<long>, at array<int>")
    return found.select("doc_id", "key", F.explode(F.arrays_zip("h", "at")).alias("w")).select("doc_id", "key", "w.h", "w.at")


def dedup(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, changed) for ``docs`` (doc_id, text).

    rows has (doc_id, n_words, sha, key, copy_of) for every row: sha is the SHA-256 of the words joined by
    spaces, key a short form of it, copy_of the smallest doc_id with these words. changed has (doc_id, key,
    n_removed, kept) for the first documents that lose some words, with the text that is left. All words of a
    copy of SPAN words or more go. Null and blank texts have no words; shorter documents keep all of theirs.
    Rows that repeat a doc_id are looked at each by itself and take nothing from each other. A row without a
    doc_id has no place in the order: it neither loses words nor takes any.
    """
    spark = docs.sparkSession
    arrow_in_small_batches(spark)
    read = docs.select("doc_id", "text").mapInArrow(_first_pass, "doc_id long, n_words long, sha string, key long, packed binary, seeds array<long>")
    # one table, written once: the texts (compressed) and their anchors
    folder = f"{shared_folder(spark)}/substrings-{uuid.uuid4().hex}"
    read.write.option("compression", "zstd").parquet(folder)
    read = spark.read.parquet(folder)
    rows = read.select("doc_id", "n_words", "sha", "key")
    firsts = cut(rows.groupBy("sha").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies")))
    copies = firsts.where("copies > 1").select("sha", "copy_of")
    rows = cut(rows.join(copies, "sha", "left").select("doc_id", "n_words", "sha", "key", F.coalesce("copy_of", "doc_id").alias("copy_of")))
    # several texts under one doc_id are told apart by their key, which is left out where it isn't needed
    one = rows.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b and doc_id is not null").isEmpty()
    by = ["doc_id"] if one else ["doc_id", "key"]
    key: Column = F.lit(0).cast("long").alias("key") if one else F.col("key")
    later = cut(rows.where("doc_id <> copy_of").select("doc_id", key).distinct())
    once = read.where("size(seeds) > 0 and doc_id is not null").select("doc_id", key, "packed", "seeds").join(if_small(later, 1_000_000), by, "left_anti").select("doc_id", "key", "packed", "seeds")
    seeds = once.select(*by, F.explode("seeds").alias("seed"))
    frequent = _frequent(seeds)
    shared_ = _lowest(seeds, "seed", frequent).where("lo < hi")
    shared_ = cut(shared_.groupBy(*by).agg(F.collect_list("seed").alias("seeds")))  # at most a document's own anchors
    mine = F.transform("seeds", lambda s: F.struct(s.alias("seed")))
    often = shared_.select(*by, F.explode(mine).alias("s")).select(*by, "s.seed").join(F.broadcast(frequent), "seed")
    often = cut(often.groupBy(*by).agg(F.collect_list("seed").alias("often")))
    both = shared_.join(if_small(often, 100_000), by, "left")
    rare = both.select(*by, F.when(F.col("often").isNull(), F.col("seeds")).otherwise(F.array_except("seeds", "often")).alias("seeds")).where("size(seeds) > 0")
    plain = once.select("doc_id", "key", "packed")
    asked = lambda ids: plain.join(if_small(ids.select(*by), 1_000_000), by, "left_semi").join(ids, by).dropDuplicates(by)
    at = Window.partitionBy("h")
    again = _windows(asked(rare)).select(*by, "h", "at").withColumn("lo", F.min("doc_id").over(at)).where("lo < doc_id").select(*by, "at")
    if not often.isEmpty():
        many = cut(_windows(asked(often.withColumnRenamed("often", "seeds"))).select(*by, "h", "at"))
        lowest = many.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        again = again.union(many.join(lowest, "h").where("lo < doc_id").select(*by, "at"))
    again = cut(again.groupBy(*by).agg(F.collect_list("at").alias("starts")))  # at most a document's own windows
    texts = asked(again).select("doc_id", "key", "packed", "starts")
    changed = texts.mapInArrow(_delete, "doc_id long, key long, n_removed long, kept string")
    return rows.withColumn("key", key), changed


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words removed, and the hash of the words kept, of every document."""
    rows, changed = dedup(table(spark, sf_dir, "documents"))
    changed = changed.select("doc_id", "key", "n_removed", F.sha2("kept", 256).alias("new_sha"))
    copied = F.coalesce((F.col("doc_id") > F.col("copy_of")) & (F.col("n_words") >= SPAN), F.lit(False))
    return rows.join(cut(changed), ["doc_id", "key"], "left").select(
        "doc_id",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
    )
