"""Scans, sinks and plug-ins on a few files and rows."""

import json
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orbitlake.operators import plugins
from orbitlake.sources import scans

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 30, 20, 8, 2, 0, 0, 0) + b"\0" * 8
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0" + struct.pack(">HBHHB", 11, 8, 20, 30, 1) + b"\0" * 8
BMP = b"BM" + b"\0" * 16 + struct.pack("<iiHH", 30, -20, 1, 24)
TIFF = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 30, 0) + struct.pack("<HHII", 257, 4, 1, 20)


def test_headers():
    found = [scans.image_size(d) for d in (PNG, JPEG, BMP, TIFF, PNG[:20], b"", None, b"\xff\xd8\xff", b"text")]
    assert found == [(30, 20, 3), (30, 20, 1), (30, 20, 3), (30, 20, 1), None, None, None, None, None]


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.png": PNG, "b.JPG": JPEG, "c.png": b"", "d.bmp": b"BM", "notes.txt": b"x", "sub/e.tif": TIFF}.items():
        (tmp_path / name).write_bytes(data)
    files = scans.scan_images(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in files.collect()] == ["a.png", "b.JPG", "d.bmp", "e.tif"]  # Spark lists no empty file
    files = files.unionByName(spark.createDataFrame([("c.png", 0, bytearray())], "path string, length long, content binary"))
    wanted = files.select("path").unionByName(spark.createDataFrame([("gone.png",)], "path string"))
    found = {r["path"].rsplit("/", 1)[-1]: r["status"] for r in scans.image_inventory(files, wanted, (30, 20), 3).collect()}
    assert found == {"a.png": "valid", "b.JPG": "channel mismatch", "c.png": "zero byte", "d.bmp": "header unreadable", "e.tif": "channel mismatch", "gone.png": "missing"}
    caps = spark.createDataFrame([("a.png", "train", "x", 1, "two"), ("a.png", "train", "x", 0, "one")], "filename string, split string, category string, caption_idx int, text string")
    rows = {r["filename"]: (r["split"], r["captions"], r["caption_count"]) for r in scans.build_manifest(scans.image_inventory(files), caps).collect()}
    assert rows["a.png"] == ("train", ["one", "two"], 2) and rows["c.png"] == ("unknown", [], 0)


def test_captions(spark, tmp_path):
    images = [
        {"imgid": 1, "filename": "airport_1.jpg", "split": "train", "category": None, "sentences": [{"raw": " a plane "}, {"raw": " "}]},
        {"imgid": None, "filename": "x.jpg", "split": "test", "category": "river", "sentences": [{"raw": "water"}]},
    ]
    (tmp_path / "c.json").write_text(json.dumps({"dataset": "d", "images": images}, indent=1))
    rows = scans.read_caption_catalog(spark, str(tmp_path / "c.json"))
    assert {(r["image_id"], r["category"], r["caption_idx"], r["text"]) for r in rows.collect()} == {("1", "airport", 0, "a plane"), ("x", "river", 0, "water")}
    assert scans.read_caption_catalog(spark, str(tmp_path / "c.json"), "test").count() == 1
    (tmp_path / "c.csv").write_text("image,caption\nb1,\"['one two' 'it\\'s' '']\"\n,\"['lost']\"\nb2,\"['three'\n 'four']\"\n")
    ok, rejects = scans.read_caption_csv(spark, str(tmp_path / "c.csv"))
    assert [tuple(r) for r in ok.orderBy("image_id").collect()] == [(0, "b1", ["one two", "it's"]), (1, "b2", ["three", "four"])]
    assert [r["captions"] for r in rejects.collect()] == [["lost"]]
    scans.write_manifest(ok, str(tmp_path / "m_csv"), "csv")
    assert spark.read.csv(str(tmp_path / "m_csv"), header=True).where("image = 'b2'").first()["captions"] == "three; four"


def test_tables(spark, tmp_path):
    good = spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string")
    scans.write_split_manifest(good, str(tmp_path / "good"))
    assert sorted(map(tuple, scans.read_split_manifest(spark, str(tmp_path / "good")).collect())) == [("a", "train"), ("b", "test")]
    scans.write_split_manifest(good.unionByName(spark.createDataFrame([("a", "val")], "id string, split string")), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        scans.read_split_manifest(spark, str(tmp_path / "bad"))
    vectors = spark.createDataFrame([("m", "d", "test", 1, [0.5, 0.25]), ("m", "d", "val", 2, [1.0, 0.0])], "model string, dataset string, split string, id long, vector array<double>")
    scans.write_embeddings(vectors, str(tmp_path / "v"))
    assert [tuple(r) for r in scans.read_embeddings(spark, str(tmp_path / "v"), "m", "d", "test").collect()] == [(1, [0.5, 0.25])]
    scans.write_results(good, str(tmp_path / "r"))
    assert scans.load_result_table(spark, str(tmp_path / "r"), "id string, split string").count() == 2
    assert scans.load_result_table(spark, str(tmp_path / "none"), "id string") is None


def test_mask_values(spark):
    found = {r["scene_id"]: (r["unexpected"], r["valid"]) for r in scans.mask_value_audit(spark.createDataFrame([(1, 0), (1, 255), (2, 7), (2, 0)], "scene_id long, v int")).collect()}
    assert found == {1: ([], True), 2: ([7], False)}


def test_plugins(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 10, 10, 10, 250, 10, 10)], "scene_id long, y int, x int, r1 int, g1 int, b1 int, r2 int, g2 int, b2 int")
    assert plugins.detect(pairs, tau=0.3).first()["hit"] == 1
    with pytest.raises(PySparkException):
        plugins.detect(pairs, lambda: F.lit(2.0)).collect()
    out = plugins.perturb(pairs, "illumination", 0.15).first()
    assert (out["r1"], out["r2"], out["g2"]) == (10, 255.0, 48.25)
    for wrong in (("illumination", 0.5, "t2"), ("contrast", 0.7, "t3")):
        with pytest.raises(ValueError):
            plugins.perturb(pairs, *wrong)
    texts = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    vectors = {r["id"]: r["vector"] for r in plugins.encode(texts, lambda t: np.stack([t.str.len() * 3, t.str.len() * 4], axis=1), 2).collect()}
    assert np.allclose(vectors[1], [0.6, 0.8]) and vectors[2] == [0.0, 0.0]
    with pytest.raises(ValueError):
        plugins.rank(texts, texts, lambda q, g: q)
