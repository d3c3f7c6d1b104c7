"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.functions.lineage import checkpoint_folder, cut, shuffles_go, stored  # noqa: F401

#: A word of the contracts: a run of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows up to which a side is small enough to be sent to every executor (a few MB each).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share for tables on their way."""
    return checkpoint_folder(spark)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row.

    Catalyst would put an expression in place of its name, and so compute it again for each
    element where a lambda uses it and for each filter; it doesn't go through a generator.
    """
    names = list(columns)
    rows = df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_fixed"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[F.col(f"_fixed.{n}").alias(n) for n in names])


def if_small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast if counting shows at most ``rows`` rows, else unmarked.

    Meant for cut tables of narrow rows, where the count reads no more than the table.
    """
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def arrow_in_small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at a time: a batch is at most 256 rows or 16 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that are part of a word: all but space and \t \n \v \f \r.
WORD_BYTES = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    ups = [np.full(max(1, n), np.uint64(x), np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for x in ups:
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return ups[0], ups[1]


class WordHashes:
    """Hashes of the words of texts, from the bytes that an Arrow batch holds them in.

    A word's hash is a polynomial over a random number for each of its bytes, which running
    sums give for all words at once, finished by mix64. ``word`` tells which bytes are part of
    words; A-Z count as a-z if ``lower``.
    """

    def __init__(self, lower: bool, word: np.ndarray = WORD_BYTES):
        of = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            of[ord("A") : ord("Z") + 1] = of[ord("a") : ord("z") + 1]
        self.of, self.word = of, word
        self.up, self.down = _powers(1 << 16)

    def _some(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, starts) of the words of ``data``, in which texts begin at ``breaks``."""
        if len(data) >= len(self.up):
            self.up, self.down = _powers(2 * len(data))
        is_word = np.zeros(len(data) + 2, bool)
        np.take(self.word, data, out=is_word[1:-1])
        begin = is_word[1:-1] & ~is_word[:-2]
        end = is_word[1:-1] & ~is_word[2:]
        inner = breaks[(breaks > 0) & (breaks < len(data))]
        begin[inner] = is_word[1:-1][inner]
        end[inner - 1] = is_word[1:-1][inner - 1]
        first, last = np.flatnonzero(begin), np.flatnonzero(end)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of[data] * self.up[: len(data)], out=sums[1:])
        raw = (sums[last + 1] - sums[first]) * self.down[first]
        return mix64(raw + (last - first).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), first

    def __call__(self, texts: pa.Array, most: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, where each text's words begin among them, and their number); null is empty."""
        offsets, data = text_bytes(texts)
        hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
        for a, b in _spans(offsets, most):
            h, first = self._some(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a])
            counts[a:b] = np.diff(np.append(np.searchsorted(first, offsets[a:b] - offsets[a]), len(first)))
            hashes.append(h)
        return np.concatenate(hashes), np.concatenate(([0], np.cumsum(counts)))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the UTF-8 of ``texts``; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    return ends, np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)


def _spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring entries that ``offsets`` bound, ``most`` or a single one at a time."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def ragged(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow lists of the entries of ``flat`` between ``offsets``."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
