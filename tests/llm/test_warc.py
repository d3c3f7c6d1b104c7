"""Archives read back, runs merged, and both against a plain computation."""

import glob
import gzip
import hashlib
import heapq
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from orbitlake.llm import warc

SCHEMA = "page_id long, url string, html string"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def expected(rows):
    most = {}
    for page, _, html in rows:
        if page is not None:
            most[html or ""] = max(page, most.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        target = most.get(html or "") if len(data) >= 1000 else None
        target = None if target == page else target
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if target is None else "revisit", target))
    return sorted(out, key=str)


def archived(spark, folder, rows, extra=""):
    frame = spark.createDataFrame([(*r, *([7] * extra.count("long"))) for r in rows], SCHEMA + extra).repartition(3)
    warc.write_archives(frame, folder, F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) % 50))
    return warc.histories(warc.read_archives(spark, folder))


def pages():
    rng = random.Random(4)
    long = ["x" * 1000, "é" * 500, "WARC/1.1\r\n\r\n" * 100, "\n".join(str(i) for i in range(400)), "\U0001f600" * 300_000]
    rows = [(i, f"https://www.Site{i % 5}.example.com:443/a{i % 7}/?q={i}#x", rng.choice([*long, "short", "x" * 999, f"own {i}" * 300, None, ""])) for i in range(200)]
    return [*rows, (300, None, "x" * 1000), (301, "no address\r\nX: y", "x" * 1000), (None, "http://a/", "x" * 1000), (None, "http://a/", "only null" * 200), (400, "http://b/", "twice " * 200), (400, "http://b/", "twice " * 200)]


def test_round_trip(spark, tmp_path):
    rows = pages()
    index = archived(spark, f"{tmp_path}/a", rows, ", payload long, same long, target long, salt long, refers_to long")
    assert sorted((tuple(r) for r in index.select(*COLUMNS).collect()), key=str) == expected(rows)
    got = [tuple(r) for r in index.select(*warc.ORDER).collect()]
    assert got == sorted(got, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, *x[3:]))
    assert {r["urlkey"] for r in index.where("page_id = 4").collect()} == {"com,example,site4)/a4/?q=4"}
    assert len({r["archive"] for r in index.collect()}) > 1


def test_records_stand_where_the_index_says(spark, tmp_path):
    rows = pages()[:50]
    texts = {os.path.basename(p): gzip.open(p).read() for _ in [archived(spark, f"{tmp_path}/a", rows).collect()] for p in glob.glob(f"{tmp_path}/a/*.gz")}
    for r in warc.read_archives(spark, f"{tmp_path}/a").collect():
        record = texts[r["archive"]][r["offset"] :]
        head, _, rest = record.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and f"<urn:page:{r['page_id']}>".encode() in head
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[size : size + 4] == b"\r\n\r\n"
        assert (hashlib.sha1(rest[:size].partition(b"\r\n\r\n")[2]).hexdigest() == r["payload_digest"]) == (r["record_type"] == "response")


def test_many_repeated_payloads_are_joined_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 1)
    rows = pages()
    assert sorted((tuple(r) for r in archived(spark, f"{tmp_path}/a", rows).select(*COLUMNS).collect()), key=str) == expected(rows)


def test_damage_is_found(spark, tmp_path):
    archived(spark, f"{tmp_path}/a", [(1, "http://a/", "text " * 300)])
    data = gzip.open(glob.glob(f"{tmp_path}/a/*.gz")[0]).read()
    for bad in (data.replace(b"text text", b"text tent", 1), data[:-3], data[5:]):
        with pytest.raises(ValueError):
            warc.entries("a", bad)


def test_empty_table(spark, tmp_path):
    assert archived(spark, f"{tmp_path}/a", []).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((0, rng.randrange(50), i, j) for j in range(rng.choice([0, 1, 7, 30]))) for i in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


def test_query_against_sql(spark, tmp_path):
    rows = [r for r in pages() if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({warc.SQL}) q").fetchall(), key=str)
    assert sorted((tuple(r) for r in warc.op12_warc(spark, str(tmp_path)).select(*COLUMNS).collect()), key=str) == want == expected(rows)
