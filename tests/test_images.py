"""Folders of good and bad files through the data source."""

import hashlib
import struct

import pytest

from orbitlake.sources import images

END = b"\0\0\0\0IEND\xaeB`\x82"


def png(w=30, h=20, colour=2, end=END):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", w, h, 8, colour, 0, 0, 0) + b"\0" * 40 + end


def jpeg(w=30, h=20, channels=3, before=0, end=b"\xff\xd9"):
    app = b"\xff\xe1" + struct.pack(">H", before + 2) + b"\xff" * before if before else b""
    return b"\xff\xd8" + app + b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * channels, 8, h, w, channels) + b"\0" * 30 + end


BMP = b"BM" + b"\0" * 16 + struct.pack("<iiHH", 30, -20, 1, 24) + b"\0" * 9
TIFF = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 30, 0) + struct.pack("<HHII", 257, 4, 1, 20)


def folder(path, files):
    for name, data in files.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_bytes(data)
    return str(path)


FILES = {
    "good_1.png": png(), "good_2.JPG": jpeg(before=60_000), "deep/er/good_3.bmp": BMP, "copy.png": png(), "zero.png": b"", "corrupt.jpg": b"no image at all", "short.png": png()[:20],
    "cut.png": png(end=b""), "cut.jpeg": jpeg(end=b""), "large.png": png(64, 64), "grey_1.png": png(colour=0), "flat.png": png(0, 20), "notes.txt": b"text", "grey.tif": TIFF,
}
WANT = {
    "good_1.png": "valid", "good_2.JPG": "valid", "good_3.bmp": "valid", "copy.png": "valid", "zero.png": "zero byte", "corrupt.jpg": "header unreadable", "short.png": "header unreadable",
    "cut.png": "truncated", "cut.jpeg": "truncated", "large.png": "dimension mismatch", "grey_1.png": "channel mismatch", "flat.png": "bad dimensions", "grey.tif": "channel mismatch",
}


def test_every_rung_comes_from_a_folder(spark, tmp_path):
    root = folder(tmp_path, FILES)
    files = images.image_files(spark, root)
    found = {r["name"]: r for r in images.with_status(files, side=(30, 20), channels=3).collect()}
    assert {n: r["status"] for n, r in found.items()} == WANT
    assert found["good_2.JPG"]["format"] == "JPEG" and found["grey.tif"]["mode"] == "L" and found["good_1.png"]["sha256"] == hashlib.sha256(png()).hexdigest()
    every = images.with_status(images.image_files(spark, root, every=True, hashed=False))
    assert {r["name"]: r["status"] for r in every.collect()}["notes.txt"] == "unsupported extension" and every.where("sha256 IS NOT NULL").count() == 0
    wanted = spark.createDataFrame([("gone.png",), ("zero.png",)], "name string")
    assert {r["name"]: r["status"] for r in images.with_status(files, wanted).collect()} == {"gone.png": "missing", "zero.png": "zero byte"}


def test_report(spark, tmp_path):
    checked = images.with_status(images.image_files(spark, folder(tmp_path, FILES)), side=(30, 20), channels=3)
    found = {(r["part"], r["key"]): r["n"] for r in images.verification_report(checked).collect()}
    assert found == {
        ("files", "valid"): 4, ("files", "invalid"): 9, ("files", "repeated"): 1, ("mode", "RGB"): 4, ("size", "30x20"): 4, ("category", "good"): 3, ("category", "unclassified"): 1,
        ("error", "dimension"): 2, ("error", "channel"): 2, ("error", "corrupted"): 5,
    }


def test_pairs(spark, tmp_path):
    sides = {"A": {"1.png": png(), "2.png": png(), "3.png": png(), "5.png": png(), "6.png": png()}, "B": {"1.png": png(), "2.png": png(9, 9), "4.png": png(), "5.png": b"", "6.png": png()}, "label": {"1.png": png(), "2.png": png(), "3.png": png(), "4.png": png(), "5.png": png()}}
    frames = [images.with_status(images.image_files(spark, folder(tmp_path / s, f))) for s, f in sides.items()]
    found = {r["stem"]: r["error"] for r in images.pair_checks(*frames).collect()}
    assert found == {"1": None, "2": "size of B differs", "3": "Missing in B/", "4": "Missing in A/", "5": "B: zero byte", "6": "Missing in label/"}


def test_empty_folder(spark, tmp_path):
    assert images.image_files(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("data", [png(), jpeg(before=50_000), BMP, TIFF])
def test_headers_are_read_by_ranges(data):
    read = []
    found = images.header(lambda a, n: (read.append(n), data[a : a + n])[1], len(data))
    assert found[1:3] == (30, 20) and sum(read) < 120
