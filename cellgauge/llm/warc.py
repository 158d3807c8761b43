"""WARC archives with a two-level capture index.

Archives are written as plain WARC 1.0 files, one record after the other, by Spark's text
writer, whose line end is the end of a record. The index is sorted by reversed-host URL
key: its lines lie in compressed blocks, and a sparse directory holds the first key of
each block. A lookup searches the bounds of the index partitions, then the directory of
one partition, then one block, each by bisection, and gives the byte range of a record;
only such ranges are read from the archives.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.llm.store import new_path, shuffle_partitions, written

FILE_BYTES = 16 << 20
BLOCK_LINES = 512
RECORD_END = "\r\n\r\n"
ID_PREFIX = "urn:page:"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
# The alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1_hex: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal: four letters for five digits."""
    letters = []
    for at in range(0, 40, 5):
        number = F.conv(F.substring(sha1_hex, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            five = F.shiftright(number, shift).bitwiseAND(F.lit(31))
            letters.append(F.substr(F.lit(BASE32), five + 1, F.lit(1)))
    return F.concat(*letters)


def target_uri(url: Column) -> Column:
    """A URL as a header value: control characters and blanks are percent-coded."""
    out = F.coalesce(url, F.lit(""))
    for plain, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to, refers_uri) of pages whose payload another page's record holds.

    Of equal payloads the largest page_id's is the response. Pages without an id are
    responses always. Only ids, digests and URLs are shuffled.
    """
    rows = pages.select(
        "page_id", F.sha1(payload(F.col("html"))).alias("digest"), target_uri(F.col("url")).alias("uri")
    )
    rows = rows.where("page_id is not null")
    heads = rows.groupBy("digest").agg(F.max(F.struct("page_id", "uri")).alias("head"), F.count("*").alias("n"))
    heads = written(heads.where("n > 1").select("digest", "head"), "heads")
    found = rows.join(heads, "digest").where(F.col("page_id") < F.col("head.page_id"))
    found = found.select("page_id", "digest", F.col("head.page_id").alias("refers_to"), F.col("head.uri").alias("refers_uri"))
    return written(found.distinct(), "revisits")


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each page (page_id, url, html) below `path`.

    Null pages have empty payloads and null URLs empty targets; repeated rows have a
    record each; no rows write no record. Files hold `file_bytes` of average records.
    """
    pages = pages.select("page_id", "url", "html")
    size = pages.agg(F.avg(F.octet_length(payload(F.col("html"))) + 600)).first()[0] or 600
    marked = pages.withColumn("digest", F.sha1(payload(F.col("html"))))
    rows = marked.join(revisits(pages), ["page_id", "digest"], "left")
    body = payload(F.col("html"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(http.cast("binary"), F.when(again, F.lit("").cast("binary")).otherwise(body))
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{ID_PREFIX}"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        target_uri(F.col("url")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"),
        base32(F.col("digest")),
        F.coalesce(
            F.concat(
                F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{ID_PREFIX}"),
                F.col("refers_to").cast("string"),
                F.lit(">\r\nWARC-Refers-To-Target-URI: "),
                F.col("refers_uri"),
            ),
            F.lit(""),
        ),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    record = F.concat(header.cast("binary"), block).cast("string")
    writer = rows.select(record.alias("value")).write.option("lineSep", RECORD_END)
    writer.option("maxRecordsPerFile", max(1, int(file_bytes // size))).text(path)


def url_key(url: str) -> str:
    """Reversed-host key: host labels from the last on, port, then path and query."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return ")" + url
    labels = ",".join(reversed(host.split(".")))
    rest = parts.path + ("?" + parts.query if parts.query else "")
    return labels + (f":{port}" if port else "") + ")" + rest


def parse_headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Headers of the record at an offset, and where its block begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    return dict(line.split(": ", 1) for line in lines[1:]), end + 4


def page_of(urn: str) -> str:
    return urn.removeprefix(f"<{ID_PREFIX}").removesuffix(">")


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, headers) of each record of an archive."""
    at = 0
    while at < len(data):
        headers, block = parse_headers(data, at)
        end = block + int(headers["Content-Length"])
        yield at, end - at, headers
        at = end + len(RECORD_END)


CAPTURE = (
    "key string, page string, file string, start long, length long, kind string, digest string, "
    "refers_to string, refers_key string"
)
CAPTURE_FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]


def scan_captures(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of all archives below a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                file, data = batch["path"][i].as_py(), batch["content"][i].as_py()
                rows = [
                    (
                        url_key(h.get("WARC-Target-URI", "")),
                        page_of(h["WARC-Record-ID"]),
                        file,
                        at,
                        length,
                        h["WARC-Type"],
                        h.get("WARC-Payload-Digest"),
                        page_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None,
                        url_key(h["WARC-Refers-To-Target-URI"]) if "WARC-Refers-To" in h else None,
                    )
                    for at, length, h in records(data)
                ]
                yield _capture_batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, CAPTURE)


def _capture_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64() if c in ("start", "length") else pa.string() for c in CAPTURE_FIELDS]
    columns = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], CAPTURE_FIELDS
    )


def _line(row: dict) -> bytes:
    return "\t".join(_field("" if row[c] is None else row[c]) for c in CAPTURE_FIELDS).encode()


def _field(value: object) -> str:
    return str(value).replace("%", "%25").replace("\t", "%09").replace("\n", "%0A")


def _unfield(value: str) -> str:
    return unquote(value)


def build_index(captures: DataFrame, path: str | None = None) -> DataFrame:
    """Write the index of captures: (part, block, first_key, last_key, lines, data).

    Range partitions by key, so a host with a third of all captures is spread; the record
    id and place break ties of equal keys, which may fill several blocks and partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held = TaskContext.get().partitionId(), 0, []

        def flush(rows):
            data = zlib.compress(b"\n".join(map(_line, rows)), 6)
            values = [[part], [block], [rows[0]["key"]], [rows[-1]["key"]], [len(rows)], [data]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(v, t)
                    for v, t in zip(
                        values,
                        [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary()],
                        strict=True,
                    )
                ],
                ["part", "block", "first_key", "last_key", "lines", "data"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == BLOCK_LINES:
                    yield flush(held)
                    held, block = [], block + 1
        if held:
            yield flush(held)

    order = ["key", "page", "file", "start"]
    spread = captures.repartitionByRange(shuffle_partitions(captures.sparkSession), *order)
    blocks = spread.sortWithinPartitions(*order).mapInArrow(
        run, "part int, block int, first_key string, last_key string, lines int, data binary"
    )
    return written(blocks, "captures", path)


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Captures of the wanted keys (column `key`), by two-level bisection.

    The driver holds two keys per index partition, whose number is chosen when the index
    is written. The directory of a partition and the wanted keys that fall into it meet
    in one task; only blocks that may hold one of them are decompressed.
    """
    spark = index.sparkSession
    bounds = index.groupBy("part").agg(F.min("first_key"), F.max("last_key")).orderBy("part").collect()
    parts = [r[0] for r in bounds]
    first, last = [r[1] for r in bounds], [r[2] for r in bounds]
    shared = spark.sparkContext.broadcast((parts, first, last))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first, last = shared.value
        for batch in batches:
            keys, where = [], []
            for key in batch["key"].to_pylist():
                for p in parts[bisect_left(last, key) : bisect_right(first, key)]:
                    keys.append(key)
                    where.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(keys, pa.string())], ["part", "key"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = sorted(set(right["key"].to_pylist()))
        if not keys or not len(left):
            return pa.Table.from_batches([_capture_batch([])])
        left = left.sort_by("block")
        first, last = left["first_key"].to_pylist(), left["last_key"].to_pylist()
        needed: dict[int, list[str]] = {}
        for key in keys:
            for b in range(bisect_left(last, key), bisect_right(first, key)):
                needed.setdefault(b, []).append(key)
        out = []
        for b, inside in sorted(needed.items()):
            lines = zlib.decompress(left["data"][b].as_py()).decode().split("\n")
            held = [_unfield(line.split("\t", 1)[0]) for line in lines]
            for key in inside:
                for line in lines[bisect_left(held, key) : bisect_right(held, key)]:
                    f = [_unfield(x) for x in line.split("\t")]
                    out.append((*f[:3], int(f[3]), int(f[4]), f[5], *(x or None for x in f[6:])))
        return pa.Table.from_batches([_capture_batch(out)])

    routed = wanted.select("key").distinct().mapInArrow(route, "part int, key string")
    return index.groupBy("part").cogroup(routed.groupBy("part")).applyInArrow(search, CAPTURE)


def with_keys(pages: DataFrame) -> DataFrame:
    """(key) of each page's URL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [url_key(u) for u in batch["uri"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

    return pages.select(target_uri(F.col("url")).alias("uri")).mapInArrow(run, "key string")


def read_ranges(captures: DataFrame) -> DataFrame:
    """(file, start, payload) of response records (file, start, length), by range reads.

    Ranges are dealt by file and read in ascending order; the files are opened by Arrow's
    file systems, so only the ranges are fetched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, source = None, None
        for batch in batches:
            for begin in range(0, len(batch), 256):
                bodies = []
                for row in batch.slice(begin, 256).to_pylist():
                    if row["file"] != name:
                        name = row["file"]
                        uri = name if "://" in name else name.replace("file:", "file://", 1)
                        system, inner = fs.FileSystem.from_uri(uri)
                        source = system.open_input_file(inner)
                    source.seek(row["start"])
                    data = source.read(row["length"])
                    _, block = parse_headers(data, 0)
                    bodies.append(data[data.index(b"\r\n\r\n", block) + 4 :])
                part = batch.slice(begin, 256)
                yield pa.RecordBatch.from_arrays(
                    [part["file"], part["start"], pa.array(bodies, pa.binary())], ["file", "start", "payload"]
                )

    ranges = captures.select("file", "start", "length")
    ranges = ranges.repartition("file", F.pmod(F.hash("start"), F.lit(4))).sortWithinPartitions("file", "start")
    return ranges.mapInArrow(run, "file string, start long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, index the archives, look every URL up and read the records back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    index = build_index(scan_captures(spark, path))
    found = written(lookup(index, with_keys(pages)), "found")
    # A revisit's payload is in the record it refers to, which the index finds by its URL.
    heads = found.where("kind = 'revisit'").select(
        F.col("refers_key").alias("key"), F.col("refers_to").alias("page"), "digest"
    )
    heads = written(heads.distinct(), "referred")
    targets = lookup(index, heads).where("kind = 'response'").join(heads, ["key", "page", "digest"], "left_semi")
    place = F.min(F.struct("file", "start", "length"))
    targets = written(targets.groupBy("key", "page", "digest").agg(place.alias("held")), "targets")
    own = found.where("kind = 'response'").select("file", "start", "length")
    bodies = read_ranges(own.union(targets.select("held.*")).distinct()).select(
        "file",
        "start",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
    )
    bodies = written(bodies, "payloads")
    refers = targets.select(F.col("key").alias("refers_key"), F.col("page").alias("refers_to"), "digest", "held")
    again = found.where("kind = 'revisit'").join(refers, ["refers_key", "refers_to", "digest"])
    again = again.select("page", "kind", "refers_to", "held.file", "held.start")
    first = found.where("kind = 'response'").select("page", "kind", "refers_to", "file", "start")
    return first.union(again).join(bodies, ["file", "start"]).select(
        F.when(F.col("page") != "", F.col("page").cast("long")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


ORACLE = f"""
WITH sized AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head
  FROM pages
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}',
    (1 + ((('0x' || substr(h, (1 + (i // 4) * 5)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < head THEN head END AS refers_to
FROM sized
"""
