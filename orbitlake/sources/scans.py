"""Scans of images, captions, splits and result tables, and what is written for them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.operators.text_search import earlier

# fixed values: suffixes of images, splits, and channels by the colour type of a PNG
SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")
SPLITS = ("train", "val", "test")
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}

CATALOG = "dataset string, images array<struct<imgid: bigint, filename: string, split: string, category: string, sentences: array<struct<raw: string, tokens: array<string>>>>>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of all image files below ``root``, by name.

    Spark's file sources list no file of zero bytes: such a file is no row here, and missing from an inventory of these rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(suffix(F.col("path")).isin(*SUFFIXES)).select("path", "length", "content").orderBy("path")


def image_size(data: bytes | None) -> tuple[int, int, int] | None:
    """Width, height and channels by the header of a PNG, JPEG, BMP or TIFF; None where it cannot be read."""
    data = data or b""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            width, height, _, colour = struct.unpack(">IIBB", data[16:26])
            return width, height, PNG_CHANNELS[colour]
        if data[:2] == b"BM":
            width, height, _, bits = struct.unpack("<iiHH", data[18:30])
            return width, abs(height), max(1, bits // 8)
        if data[:4] in (b"II*\0", b"MM\0*"):
            end = "<" if data[:1] == b"I" else ">"
            at = struct.unpack(end + "I", data[4:8])[0]
            tags = {}
            for i in range(struct.unpack(end + "H", data[at : at + 2])[0]):
                entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
                tag, kind = struct.unpack(end + "HH", entry[:4])
                tags[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
            return tags[256], tags[257], tags.get(277, 1)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data) and data[at] == 0xFF:
                mark = data[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    height, width, channels = struct.unpack(">HHB", data[at + 5 : at + 10])
                    return width, height, channels
                at += 1 if mark == 0xFF else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except (struct.error, KeyError):
        pass
    return None


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [image_size(c) or (None, None, None) for c in batch["content"]]
        out = batch[["path", "length", "sha256"]].copy()
        for i, name in enumerate(("width", "height", "channels")):
            out[name] = pd.array([f[i] for f in found], dtype="Int64")
        yield out


def image_inventory(files: DataFrame, expected: DataFrame | None = None, side: tuple[int, int] | None = None, channels: int | None = None) -> DataFrame:
    """(path, length, sha256, width, height, channels, status) of (path, length, content).

    With ``expected`` (path), paths without a file are rows too. The first that holds is the status: missing,
    unsupported extension, zero byte, header unreadable, bad dimensions, dimension mismatch, channel mismatch, valid.
    """
    rows = files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))
    out = rows.mapInPandas(_sizes, "path string, length long, sha256 string, width long, height long, channels long")
    if expected is not None:
        out = expected.select("path").join(out, "path", "left")
    ladder = [
        (F.col("length").isNull(), "missing"),
        (~suffix(F.col("path")).isin(*SUFFIXES), "unsupported extension"),
        (F.col("length") == 0, "zero byte"),
        (F.col("width").isNull(), "header unreadable"),
        ((F.col("width") <= 0) | (F.col("height") <= 0), "bad dimensions"),
    ]
    if side:
        ladder.append(((F.col("width") != side[0]) | (F.col("height") != side[1]), "dimension mismatch"))
    if channels:
        ladder.append((F.col("channels") != channels, "channel mismatch"))
    return out.withColumn("status", F.coalesce(*[F.when(c, s) for c, s in ladder], F.lit("valid")))


def mask_value_audit(rows: DataFrame, allowed: tuple[int, ...] = (0, 255)) -> DataFrame:
    """(scene_id, unexpected, valid) of mask pixels (scene_id, v)."""
    found = F.array_sort(F.array_except(F.collect_set("v"), F.array(*map(F.lit, allowed))))
    return rows.groupBy("scene_id").agg(found.alias("unexpected")).withColumn("valid", F.size("unexpected") == 0)


def read_caption_catalog(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(image_id, filename, split, category, caption_idx, text); blank captions are left out, their places are not filled."""
    images = spark.read.schema(CATALOG).json(path, multiLine=True).select(F.explode("images").alias("i")).select("i.*")
    if split is not None:
        images = images.where(F.col("split") == split)
    derived = F.coalesce(F.nullif(F.regexp_extract(F.lower("filename"), "^([a-z]+)[_0-9]", 1), F.lit("")), F.lit("unclassified"))
    name = F.coalesce(F.col("imgid").cast("string"), stem(F.col("filename")))
    rows = images.select(name.alias("image_id"), "filename", "split", F.coalesce("category", derived).alias("category"), F.posexplode("sentences").alias("caption_idx", "s"))
    return rows.withColumn("text", F.trim("s.raw")).where("text <> ''").drop("s")


def read_caption_csv(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (image, caption) as (image_id, image, captions) in file order, and those without image bytes."""
    rows = spark.read.csv(paths, header=True, multiLine=True, escape='"', schema="image string, caption string")
    inner = F.regexp_replace(F.trim("caption"), r"^\[\s*['\"]?|['\"]?\s*\]$", "")
    parts = F.transform(F.split(inner, r"(?<=['\"])\s+(?=['\"])"), lambda c: F.trim(F.replace(F.regexp_replace(F.trim(c), r"^['\"]|['\"]$", ""), F.lit("\\'"), F.lit("'"))))
    rows = rows.withColumn("captions", F.filter(parts, lambda c: c != "")).drop("caption")
    bad = F.coalesce(F.trim("image") == "", F.lit(True))
    kept = earlier(rows.where(~bad).withColumn("_at", F.monotonically_increasing_id()), "_at")
    return kept.select(F.col("before").alias("image_id"), "image", "captions"), rows.where(bad)


def write_manifest(rows: DataFrame, path: str, form: str = "json") -> None:
    """JSON with ``captions`` as an array, CSV with them joined by '; '."""
    if form == "json":
        rows.write.json(path)
    elif form == "csv":
        rows.withColumn("captions", F.concat_ws("; ", "captions")).write.csv(path, header=True, escape='"')
    else:
        raise ValueError(f"no such form: {form}")


def write_split_manifest(rows: DataFrame, path: str) -> None:
    """(id, split), one file a split's folder."""
    rows.select("id", "split").write.partitionBy("split").json(path)


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, split); an id in two splits is an error."""
    rows = spark.read.schema("id string, split string").json(path)
    twice = rows.groupBy("id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("id").head(5)
    if twice:
        raise ValueError(f"in more than one split: {[r['id'] for r in twice]}")
    return rows


def write_embeddings(rows: DataFrame, path: str) -> None:
    """(model, dataset, split, id, vector), a folder each model, dataset and split."""
    rows.withColumn("vector", F.col("vector").cast("array<float>")).write.mode("append").partitionBy("model", "dataset", "split").parquet(path)


def read_embeddings(spark: SparkSession, path: str, model: str, dataset: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("model") == model) & (F.col("dataset") == dataset) & (F.col("split") == split)).select("id", "vector")


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.csv(f"{path}/csv", header=True, escape='"')
    rows.write.json(f"{path}/json")


def load_result_table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The JSON form of a result table, else its CSV form, else None."""
    for read in (lambda: spark.read.schema(schema).json(f"{path}/json"), lambda: spark.read.schema(schema).csv(f"{path}/csv", header=True, escape='"')):
        try:
            return read()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def build_manifest(inventory: DataFrame, caps: DataFrame) -> DataFrame:
    """The image inventory with split, category and captions (filename, split, category, caption_idx, text) by file name."""
    by = caps.groupBy("filename").agg(F.first("split").alias("split"), F.first("category").alias("category"), F.transform(F.sort_array(F.collect_list(F.struct("caption_idx", "text"))), lambda c: c["text"]).alias("captions"))
    out = inventory.withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1)).join(by, "filename", "left")
    return out.fillna("unknown", ["split", "category"]).withColumn("captions", F.coalesce("captions", F.array().cast("array<string>"))).withColumn("caption_count", F.size("captions"))


def filter_split(rows: DataFrame, split: str) -> DataFrame:
    return rows.where(F.col("split") == split)
