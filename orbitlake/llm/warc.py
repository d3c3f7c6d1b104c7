"""WARC archives of pages, and their index in the order of URL and time.

Archives are written by Spark's text writer, a record a row, straight from the scan. Reading gives a run of
captures for each archive, sorted there; runs are cut into ranges of (URL key, time, page), and
in each range a loser tree merges what it holds of every run. Ranges one after the other are the
capture histories of all URLs.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm.common import BROADCAST_ROWS, cut, shared_folder, table

#: Payloads from so many bytes on are stored once.
LEAST_BYTES = 1000
#: Bytes of payload an archive holds on average at most, and captures of a range.
ARCHIVE_BYTES, RANGE_ROWS = 32 << 20, 200_000
#: Parts that captures of one payload are dealt to where the repeated payloads are too many to be sent to all executors.
SALTS = 64
# fixed values: the standard's profile of a revisit
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
ENTRY = "urlkey string, captured string, page_id long, archive string, offset long, place long, payload_bytes long, payload_digest string, record_type string, refers_to long"
ORDER = ["urlkey", "captured", "page_id", "archive", "offset"]


def with_targets(pages: DataFrame) -> DataFrame:
    """Adds refers_to to (page_id, url, html, captured): the largest page_id with the same payload, where that is another and the payload is long enough."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "captured", payload.alias("html"), F.sha2(payload, 256).alias("same"))
    long = rows.where(F.octet_length("html") >= LEAST_BYTES)
    repeated = cut(long.groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("target")).where("n > 1 AND target IS NOT NULL").select("same", "target"))
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(repeated), "same", "left")
    else:
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["same", "salt"], "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target"))
    return joined.select("page_id", "url", "captured", "html", other.alias("refers_to"))


def record(rows: DataFrame) -> Column:
    """A row's record, without the two line ends that close it: a response, or a revisit without payload if it refers to another page."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda head, value: F.concat(F.lit(f"{head}: "), value, F.lit(CRLF))
    uri = F.col("url")
    for mark in "\r\n\t ":
        uri = F.replace(uri, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    again = F.col("refers_to").isNotNull()
    length = F.octet_length("html").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", length), F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(uri.isNull(), "").otherwise(line("WARC-Target-URI", uri)),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name("refers_to")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("html"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.octet_length("html"))).cast("string")),
        F.lit(CRLF), http, F.when(again, "").otherwise(F.col("html")),
    )


def write_archives(pages: DataFrame, folder: str, captured: Column) -> None:
    """Writes a record for each row of (page_id, url, html) into gzipped archives in ``folder``, which all executors reach.

    ``captured`` is a row's time, UTC. A null html is an empty payload, a null url gives a record without
    address, a null time that of the epoch. Rows without a page_id are records without a number, and no target of others. Of
    equal payloads all with the largest page_id are responses, so repeated rows keep their payload. Other columns don't
    count, whatever their names.
    """
    when = F.coalesce(captured.cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", when.alias("captured"))
    size = rows.agg(F.coalesce(F.avg(F.octet_length("html")), F.lit(0.0))).first()[0]
    done = with_targets(rows)
    done.select(record(done).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (size + 1000)))).text(folder)


ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)")


def url_key(url: str | None) -> str:
    """Host from its end on, then port, path and query; without www, usual ports, a last slash and what follows #."""
    found = ADDRESS.match(url or "")
    if not found:
        return (url or "").lower()
    host, port, rest = found.groups()
    names = re.sub(r"^www\d*\.", "", host.lower()).split(".")
    return ",".join(reversed(names)) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (rest.removesuffix("/") or "/")


def _headers(text: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in text.decode().split(CRLF)[1:])}


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return None if digits in ("", "none") else int(digits)


def entries(archive: str, data: bytes) -> list[tuple]:
    """What the records of an archive say, in the order of ORDER; a record that isn't whole is an error."""
    out, at = [], 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        of = _headers(data[at:head]) if head > 0 and data.startswith(b"WARC/1.1\r\n", at) else {}
        if "content-length" not in of:
            raise ValueError(f"{archive}: no record at {at}")
        first, end = head + 4, head + 4 + int(of["content-length"])
        block = memoryview(data)[first:end]
        body = data.find(b"\r\n\r\n", first, end) + 4
        size, digest = int(_headers(data[first : body - 4])["content-length"]), of["warc-payload-digest"].removeprefix("sha1:")
        if of["warc-type"] == "response" and (end - body != size or hashlib.sha1(block[body - first :]).hexdigest() != digest):
            raise ValueError(f"{archive}: the payload at {body} isn't what its record says")
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"{archive}: the record at {at} doesn't end where it says")
        out.append((url_key(of.get("warc-target-uri")), of["warc-date"], _number(of["warc-record-id"]), archive, at, size, digest, of["warc-type"], _number(of.get("warc-refers-to"))))
        at = end + 4
    out.sort(key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[4]))
    return [(*x[:5], place, *x[5:]) for place, x in enumerate(out)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            found = entries(path.as_py().rpartition("/")[2], gzip.decompress(content.as_buffer()))
            columns = list(zip(*found, strict=True)) or [()] * 10
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in ENTRY.split(", ")]
            yield from pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}).to_batches(max_chunksize=10_000)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its last match, so that the next entry takes one match a level."""

    LAST = (1,)  # above all keys, which begin with 0

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, k = runs, len(runs)
        self.heads = [next(r, self.LAST) for r in runs]
        self.losers = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.heads[a] < self.heads[b] else (b, a)
        self.winner = winners[1] if k else 0

    def __iter__(self) -> Iterator[tuple]:
        heads, losers, k = self.heads, self.losers, len(self.runs)
        while k and heads[self.winner] is not self.LAST:
            w = self.winner
            yield heads[w]
            heads[w] = next(self.runs[w], self.LAST)
            node = (k + w) // 2
            while node:
                if heads[losers[node]] < heads[w]:
                    losers[node], w = w, losers[node]
                node //= 2
            self.winner = w


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its rows come run by run, each in order."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    rows = pa.Table.from_batches(found).combine_chunks()
    urls, times, ids, names, offsets = (rows[c].to_pylist() for c in ORDER)
    begins = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]

    def run(first: int, end: int) -> Iterator[tuple]:
        return ((0, urls[i], times[i], ids[i] is not None, ids[i] or 0, names[i], offsets[i], i) for i in range(first, end))

    order = [key[-1] for key in LoserTree([run(a, b) for a, b in zip(begins, begins[1:], strict=False)])]
    yield from rows.take(pa.array(order)).to_batches(max_chunksize=10_000)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives in ``folder``, each archive's in the order of ORDER (``place``); payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content").mapInArrow(_runs, ENTRY)


def histories(index: DataFrame) -> DataFrame:
    """``index`` in the order of ORDER over all archives: by rows within a partition, and from partition to partition."""
    index = cut(index)
    rows = index.count()
    n = max(1, -(-rows // RANGE_ROWS), min(index.sparkSession.sparkContext.defaultParallelism, rows // 1000))
    return index.repartitionByRange(n, *ORDER).sortWithinPartitions("archive", "place").mapInArrow(_merged, ENTRY)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each; pages have no times, so they count as captured a second apart by page_id."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    second = F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(F.col("page_id"), F.lit(1_000_000_000)))
    write_archives(table(spark, sf_dir, "pages"), folder, second)
    return histories(read_archives(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""SELECT page_id, bytes::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN target IS NULL THEN 'response' ELSE 'revisit' END AS record_type, target AS refers_to
FROM (SELECT page_id, html, bytes, CASE WHEN bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM most THEN most END AS target
  FROM (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS most FROM pages))"""
