"""A data source of image files: all of them, empty ones too, with what their headers say.

Paths are listed once; each partition then reads a few files, of each only the ranges that its header stands in, and
all of it in pieces where hashes are asked for. Files are reached by pyarrow's file systems: local folders and
whatever else it has a scheme for.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator, Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: suffixes of images, and (channels, mode) by the colour type of a PNG and the channels of others
SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")
PNG_MODES = {0: (1, "L"), 2: (3, "RGB"), 3: (1, "P"), 4: (2, "LA"), 6: (4, "RGBA")}
MODES = {1: "L", 2: "LA", 3: "RGB", 4: "CMYK"}
SCHEMA = "path string, name string, suffix string, length long, sha256 string, format string, width long, height long, channels int, mode string, problem string"
#: Bytes read at a time.
PIECE = 1 << 16
NO_HEADER, CUT_OFF = "header unreadable", "truncated"

Read = Callable[[int, int], bytes]


def header(read: Read, length: int) -> tuple[str, int, int, int, str] | None:
    """(format, width, height, channels, mode) from the ranges ``read`` (start, number of bytes) that a header stands in; None if there is none."""
    try:
        first = read(0, 32)
        if first[:8] == b"\x89PNG\r\n\x1a\n" and first[12:16] == b"IHDR":
            width, height, bits, colour = struct.unpack(">IIBB", first[16:26])
            channels, mode = PNG_MODES[colour]
            return "PNG", width, height, channels, "1" if bits == 1 and colour == 0 else mode
        if first[:2] == b"BM":
            width, height, _, bits = struct.unpack("<iiHH", first[18:30])
            channels = max(1, bits // 8)
            return "BMP", width, abs(height), channels, {1: "P", 3: "RGB", 4: "RGBA"}.get(channels, "RGB")
        if first[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(read, first)
        if first[:2] == b"\xff\xd8":
            return _jpeg(read, length)
    except (struct.error, KeyError):
        pass
    return None


def _tiff(read: Read, first: bytes) -> tuple[str, int, int, int, str]:
    end = "<" if first[:1] == b"I" else ">"
    at = struct.unpack(end + "I", first[4:8])[0]
    n = struct.unpack(end + "H", read(at, 2))[0]
    entries, tags = read(at + 2, 12 * n), {}
    for i in range(n):
        tag, kind = struct.unpack(end + "HH", entries[12 * i : 12 * i + 4])
        tags[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), entries[12 * i + 8 : 12 * i + (10 if kind == 3 else 12)])[0]
    channels = tags.get(277, 1)
    return "TIFF", tags[256], tags[257], channels, MODES.get(channels, "RGB")


def _jpeg(read: Read, length: int) -> tuple[str, int, int, int, str] | None:
    """Goes from segment to segment, so that large metadata is skipped, not read."""
    at = 2
    while at + 9 < length:
        mark = read(at, 9)
        if len(mark) < 9 or mark[0] != 0xFF:
            return None
        if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", mark[5:9])
            channels = read(at + 9, 1)[0]
            return "JPEG", width, height, channels, MODES.get(channels, "RGB")
        at += 1 if mark[1] == 0xFF else 2 + struct.unpack(">H", mark[2:4])[0]
    return None


def complete(kind: str, read: Read, length: int) -> bool:
    """Whether a PNG or JPEG has its end mark; other formats pass. Pixels aren't decoded."""
    tail = read(max(0, length - 12), 12)
    return {"PNG": tail[4:8] == b"IEND", "JPEG": b"\xff\xd9" in tail}.get(kind, True)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.hashed, self.every = options["path"], options.get("sha256", "true") == "true", options.get("all", "false") == "true"
        self.parts = int(options.get("partitions", "64"))

    def partitions(self) -> Sequence[InputPartition]:
        """Files by their size over the partitions, largest first, so that one with large files gets few."""
        fs, root = pafs.FileSystem.from_uri(self.root) if "://" in self.root else (pafs.LocalFileSystem(), self.root)
        found = [(f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File]
        if not self.every:
            found = [(p, n) for p, n in found if p.rpartition(".")[2].lower() in SUFFIXES]
        found.sort(key=lambda f: (-f[1], f[0]))
        n = max(1, min(self.parts, len(found)))
        return [Files(found[i::n]) for i in range(n)]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs = pafs.FileSystem.from_uri(self.root)[0] if "://" in self.root else pafs.LocalFileSystem()
        for path, length in partition.files:
            with fs.open_input_file(path) as file:
                yield self.row(path, length, lambda a, n, file=file: file.read_at(n, a))

    def row(self, path: str, length: int, read: Read) -> tuple:
        name = path.rpartition("/")[2]
        suffix = name.rpartition(".")[2].lower() if "." in name else ""
        sha, found, problem = None, None, None
        if length and suffix in SUFFIXES:
            if self.hashed:
                h = hashlib.sha256()
                for at in range(0, length, PIECE):
                    h.update(read(at, min(PIECE, length - at)))
                sha = h.hexdigest()
            found = header(read, length)
            problem = NO_HEADER if found is None else None if complete(found[0], read, length) else CUT_OFF
        return (path, name, suffix, length, sha, *(found or (None,) * 5), problem)


class ImageFiles(DataSource):
    """Options: path; sha256 (true or false); all (files of other suffixes too); partitions."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ImageReader(dict(self.options))


def image_files(spark: SparkSession, root: str, every: bool = False, hashed: bool = True) -> DataFrame:
    """A row an image file below ``root`` (SCHEMA), or any file with ``every``; files of no bytes are rows."""
    spark.dataSource.register(ImageFiles)
    return spark.read.format("image_files").option("all", str(every).lower()).option("sha256", str(hashed).lower()).option("partitions", str(4 * spark.sparkContext.defaultParallelism)).load(root)


def with_status(files: DataFrame, expected: DataFrame | None = None, side: tuple[int, int] | None = None, channels: int | None = None) -> DataFrame:
    """Adds ``status`` to ``image_files``: the first that holds of missing (with ``expected`` (name), names without a file), unsupported extension, zero byte, header unreadable, bad dimensions, truncated, dimension mismatch, channel mismatch, valid."""
    out = expected.select("name").distinct().join(files, "name", "left") if expected is not None else files
    ladder = [
        (F.col("length").isNull(), "missing"),
        (~F.col("suffix").isin(*SUFFIXES), "unsupported extension"),
        (F.col("length") == 0, "zero byte"),
        (F.col("problem") == NO_HEADER, NO_HEADER),
        ((F.col("width") <= 0) | (F.col("height") <= 0), "bad dimensions"),
        (F.col("problem") == CUT_OFF, CUT_OFF),
    ]
    if side:
        ladder.append(((F.col("width") != side[0]) | (F.col("height") != side[1]), "dimension mismatch"))
    if channels:
        ladder.append((F.col("channels") != channels, "channel mismatch"))
    return out.withColumn("status", F.coalesce(*[F.when(c, s) for c, s in ladder], F.lit("valid")))


# fixed values: which bucket of the report an error falls into
BUCKETS = {"dimension mismatch": "dimension", "bad dimensions": "dimension", "channel mismatch": "channel"}


def verification_report(checked: DataFrame, category: str = "unclassified") -> DataFrame:
    """(part, key, n) of files with status: valid and invalid ones; modes, sizes and categories (the name up to its first _) of valid ones; errors by dimension, channel, corrupted; files that repeat another."""
    valid = F.col("status") == "valid"
    of = F.lower(F.coalesce(F.nullif(F.regexp_extract("name", "^([^_]*)_", 1), F.lit("")), F.lit(category)))
    bucket = F.coalesce(*[F.when(F.col("status") == s, b) for s, b in BUCKETS.items()], F.lit("corrupted"))
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    facts = [("files", F.when(valid, "valid").otherwise("invalid"), F.lit(True)), ("mode", F.col("mode"), valid), ("size", size, valid), ("category", of, valid), ("error", bucket, ~valid)]
    rows = checked.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.when(where, key).alias("key")) for p, key, where in facts])).alias("f")).select("f.*")
    counts = rows.where("key IS NOT NULL").groupBy("part", "key").agg(F.count("*").alias("n"))
    copies = checked.where("sha256 IS NOT NULL").groupBy("sha256").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n"))
    return counts.unionByName(copies.select(F.lit("files").alias("part"), F.lit("repeated").alias("key"), "n"))


def pair_checks(a: DataFrame, b: DataFrame, label: DataFrame) -> DataFrame:
    """(stem, error) of before, after and label files with status, by the name without suffix: the first of missing in A, B or label, a file that isn't valid, sizes that differ; null where all is well."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    sides = [df.select(stem.alias("stem"), F.col("status").alias(f"s{i}"), F.struct("width", "height").alias(f"d{i}"), F.col("name").alias(f"n{i}")) for i, df in enumerate((a, b, label))]
    rows = sides[0].join(sides[1], "stem", "full").join(sides[2], "stem", "full")
    names = ("A", "B", "label")
    missing = [F.when(F.col(f"n{i}").isNull(), f"Missing in {x}/") for i, x in enumerate(names)]
    broken = [F.when(F.col(f"s{i}") != "valid", F.concat(F.lit(f"{x}: "), f"s{i}")) for i, x in enumerate(names)]
    other = [F.when(F.col("d0") != F.col(f"d{i}"), f"size of {names[i]} differs") for i in (1, 2)]
    return rows.select("stem", F.coalesce(*missing, *broken, *other).alias("error"))
