"""WARC archives of captures: records with revisits, and a merged index of their histories.

Records are built by built-in functions and written by Spark's text writer,
whose line separator is the record separator of the format, so each file is a
gzipped WARC/1.1 stream. Reading back parses every record by its lengths, and
each archive file gives a run of index lines sorted by URL key and capture
time. Runs meet by ranges of that key and are merged with a loser tree, so the
index is globally ordered: each URL's captures stand together in time order.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, join_unique, new_path, stored

#: Payload bytes of an archive file, on average.
FILE_BYTES = 32 << 20
#: Index lines of a key range, on average: what a task merges at a time.
RANGE_LINES = 100_000
#: A capture without a time of its own is dated by its number: so many seconds after this moment, 2024-01-01 in UTC.
FIRST_CAPTURE = 1_704_067_200


def base32_of_hex(digest: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hexadecimal SHA-1: 5 digits are 20 bits, which are 4 letters."""
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null html: empty), payload_bytes, sha1, capture_s. Other columns are left out."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    taken = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20]+", "").alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("sha1"), taken.alias("capture_s")
    )


def with_originals(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """rows with refers_to (the smallest page_id of equal payloads of at least least_bytes, null for that page itself and for smaller payloads), the original's url and time, and number, which tells rows apart that are alike.

    Of rows that share the smallest page_id and the payload, one revisits none
    and the rest are the same capture again: all are responses. Rows without a
    page_id revisit none.
    """
    first = F.min(F.struct("page_id", "url", "capture_s"))
    groups = rows.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha1", "payload_bytes").agg(first.alias("first"), F.count("*").alias("n"))
    groups = stored(groups.filter(F.col("n") > 1).select("sha1", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url"), F.col("first.capture_s").alias("original_s"), "n"), "payload-groups")
    found = join_unique(rows, groups, "sha1", "n", rows.count())
    found = found.withColumn("refers_to", F.when(F.col("original") < F.col("page_id"), F.col("original"))).drop("n", "original")
    return found.withColumn("number", F.monotonically_increasing_id())


def utc_date(seconds: Column) -> Column:
    """Seconds since 1970 as a date of the format, in UTC whatever the session's time zone."""
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.concat(F.translate(at.cast("string"), " ", "T"), F.lit("Z"))


def record(rows: DataFrame) -> Column:
    """The bytes of a record but for its closing separator, as text. A revisit holds the HTTP header alone, and names its original by address and date."""
    nl = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), F.col("payload_bytes"), F.lit(nl + nl))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    # the number is the row's own within this job, so no two records have one id
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "url", "sha1", F.col("number").cast("string")))
    cut = lambda a, n: F.substring(digest, a, n)
    uid = F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("8"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uid, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Date: "), utc_date(F.col("capture_s"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("original_url"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Date: "), utc_date(F.col("original_s")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-Id: "), F.col("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    ]
    return F.concat(F.concat_ws(nl, *fields), F.lit(nl + nl), body)


def write_archives(pages: DataFrame, out: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """A record per page into gzipped archive files of about file_bytes of payload each."""
    rows = with_originals(captures(pages), least_bytes)
    total = pages.select(F.sum(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    # equal rows of one page, or of none, spread by where they were read
    dealt = rows.repartition(int(files), F.xxhash64("page_id", "sha1", F.spark_partition_id()))
    dealt.select(record(rows).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(out)


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the top, then path and query; scheme, www., default ports, fragment and case of the host don't count."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url)
    host, port, path = m[1].lower(), m[2], m[3]
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (unquote(path).lower() or "/")


class _Stream:
    """A gzipped file's bytes, unpacked a piece at a time; members may follow each other."""

    def __init__(self, packed: bytes) -> None:
        self.rest, self.z, self.buffer, self.at = packed, zlib.decompressobj(31), b"", 0

    def more(self) -> bool:
        while self.rest or not self.z.eof:
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.rest, 1 << 20)
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.buffer += got
                return True
            if not self.rest:
                return False
        return False

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.at += len(out)
        return out


def parse_archive(packed: bytes) -> Iterator[dict]:
    """Records of an archive: header fields, offset in the unpacked stream, and the payload (of a revisit: none)."""
    stream = _Stream(packed)
    while True:
        offset = stream.at
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {offset}")
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        block = stream.take(int(fields["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"record at {offset} doesn't end where its length says")
        http, _, payload = block.partition(b"\r\n\r\n")
        said = int(re.search(rb"Content-Length: (\d+)", http)[1])
        yield {"fields": fields, "offset": offset, "payload": payload, "said": said}


_INDEX = "url_key string, capture_s long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"
_KEY = ("url_key", "capture_s", "page_id")


def index_runs(spark: SparkSession, archives: str) -> DataFrame:
    """Index lines of every record, a sorted run for each archive file, stored. Payloads are held against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for r in parse_archive(content.as_py()):
                    f = r["fields"]
                    digest, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"]
                    size = r["said"] if kind == "revisit" else len(r["payload"])
                    if kind == "response":
                        digest = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                        if f["WARC-Payload-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"{path} at {r['offset']}: the payload is not that of its digest")
                    when = int(dt.datetime.fromisoformat(f["WARC-Date"]).timestamp())
                    page = int(f["X-Page-Id"]) if f.get("X-Page-Id") else None
                    of = f.get("X-Refers-To-Page-Id")
                    rows.append((url_key(f.get("WARC-Target-URI", "")), when, page, size, digest, kind, int(of) if of else None, path.rpartition("/")[2], r["offset"]))
                rows.sort(key=_order)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] if rows else [pa.array([], t) for t in _TYPES], _NAMES)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives)
    return stored(found.select("path", "content").mapInArrow(frugal(run), _INDEX), "index-runs")


_NAMES = [x.split()[0] for x in _INDEX.split(", ")]
_TYPES = [pa.string() if x.split()[1] == "string" else pa.int64() for x in _INDEX.split(", ")]


def _order(row: tuple) -> tuple:
    """URL key, capture time, page number; lines without a number first."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


class LoserTree:
    """Merge of sorted runs: each inner node keeps the loser of its match, so the next line costs one path of matches."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [0] * max(1, self.k)
        self.losers[0] = self._play(1) if self.k > 1 else 0

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (_order(row), row)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def _play(self, node: int) -> int:
        """The winner below a node; leaves are k to 2k - 1."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[win := self.losers[0]]) is not None:
            yield head[1]
            self.heads[win] = self._next(win)
            node = (win + self.k) // 2
            while node:
                if self._less(self.losers[node], win):
                    self.losers[node], win = win, self.losers[node]
                node //= 2
            self.losers[0] = win


def merged_index(runs: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """Index lines in global order of URL key, capture time and page: runs cut at the same key ranges, each range merged by a loser tree.

    Ranges are as many as the counted lines need to have about range_lines
    each; a task holds the runs of one range and hands lines on as the tree
    gives them. The key goes on to page number, file and offset, so one URL or
    host with most of the captures spreads over ranges too, and so do equal
    captures.
    """
    n = max(1, -(-runs.count() // range_lines))
    key = [F.col(c).asc_nulls_first() for c in _KEY]
    ranged = runs.repartitionByRange(n, *key, "file", "offset").sortWithinPartitions("file", *key, "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[pa.RecordBatch, int, int]]] = {}
        for b in batches:
            files = b.column("file")
            starts = [0, *(np.flatnonzero(pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for i, j in itertools.pairwise(starts):
                held.setdefault(files[i].as_py(), []).append((b, i, j))

        def lines(pieces: list[tuple[pa.RecordBatch, int, int]]) -> Iterator[tuple]:
            for b, i, j in pieces:
                for at in range(i, j, 1000):  # columns become Python values a thousand lines at a time
                    yield from zip(*[c.to_pylist() for c in b.slice(at, min(1000, j - at)).columns], strict=True)

        tree = iter(LoserTree([lines(p) for p in held.values()]))
        while part := list(itertools.islice(tree, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _TYPES, strict=True)], _NAMES)

    return ranged.select(*_NAMES).mapInArrow(frugal(merge), _INDEX)


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written and read back, as the merged index has it."""
    out = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    return merged_index(index_runs(spark, out)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first_id FROM p),
q AS (
  SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(h, 5 * k::INT + 1, 5))::BIGINT) AS g FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g[(j // 4)::INT + 1] >> (5 * (3 - j % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM q"""
