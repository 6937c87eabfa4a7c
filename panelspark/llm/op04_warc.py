"""WARC archives: write with an index, read back by coalesced byte ranges.

*Writing.* Each task appends its rows as gzip members (one record each, as ``.warc.gz`` wants it) to files
of its own in the shared folder and returns one index row per record: file, offset, length, url, digest. The
index is written as a Parquet table. A task that is run again writes new files; only the rows of the attempt that
Spark commits are in the index, so lost executors leave unreferenced files at worst, never wrong rows.

*Equal payloads.* Of records with equal payloads the one with the smallest page id is the response, all
others are revisits that name it and hold no payload. The smallest id per digest is a grouping with partial
aggregation; only digests that occur twice or more are joined back, and adaptive execution splits hot ones.

*Reading.* The index comes first: selected rows are dealt by (file, block of the offset), sorted by offset, and
neighbours with small gaps are fetched as one range read of bounded size. Each record is cut out of its range,
unzipped and parsed on its own.

The folder may be any that ``pyarrow.fs`` knows by its URI (file, hdfs, s3, gs); nothing goes through the driver.

Edge cases: a null page is an empty payload; an empty payload has a digest like any other; a null id counts as
the largest; rows that repeat id and payload are written alike; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stage

INDEX = "page_id {id}, url string, file string, offset bigint, length bigint, payload_digest string, record_type string, refers_to {id}"
RECORDS = "page_id {id}, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to {id}"
#: WARC record ids are name-based UUIDs in this namespace.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _line(s: str) -> str:
    """A header value on one line."""
    return s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(s: str) -> str:
    return s.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header (and so the full length), not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {_line(str(page_id))}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{refers_to}')}>"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {_line(str(refers_to))}")
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields, ``payload`` (None for a revisit) and ``payload_bytes`` of one unzipped record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return fields | {"payload": None if fields["WARC-Type"] == "revisit" else payload, "payload_bytes": sizes[0]}


def with_originals(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """_id, _url, _payload, _first (id of the record with the same payload that is kept whole), _revisit."""
    df = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"),
                      F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "utf-8").alias("_payload"))
    df = df.withColumn("_sha", F.sha1("_payload"))
    twice = (df.filter(F.length("_payload") >= min_bytes).groupBy(F.col("_sha").alias("f_sha"))
             .agg(F.min("_id").alias("_first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    df = df.join(twice, (F.col("_sha") == F.col("f_sha")) & (F.length("_payload") >= min_bytes), "left")
    return df.select("_id", "_url", "_payload", "_first",
                     (F.col("f_sha").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))).alias("_revisit"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *,
                   min_bytes: int = 0, file_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row below ``folder`` (a URI that all executors share); the index table.

    ``min_bytes``: smaller payloads are never revisits. ``file_bytes``: a task begins a new file beyond it."""
    df = with_originals(pages, id_col, url_col, html_col, min_bytes)
    id_type = df.schema["_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, at, name = None, 0, None
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    digest = base32_sha1(payload)
                    member = gzip.compress(make_record(page_id, url, payload, digest, first, revisit, date), 6, mtime=0)
                    out.write(member)
                    rows.append((page_id, url, name, at, len(member), digest, "revisit" if revisit else "response",
                                 first if revisit else None))
                    at += len(member)
                kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                         batch.schema.field(0).type]
                names = ["page_id", "url", "file", "offset", "length", "payload_digest", "record_type", "refers_to"]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return stage(df.mapInArrow(write, INDEX.format(id=id_type)), "op4-index")


def read_records(index: DataFrame, folder: str, *, gap_bytes: int = 1 << 16, range_bytes: int = 4 << 20,
                 block_bytes: int = 4 << 20) -> DataFrame:
    """The records that ``index`` rows (all of them, or any selection) point to, parsed.

    ``gap_bytes``: neighbours at most this far apart are fetched together; ``range_bytes``: most bytes of
    one fetch, unless one record is longer; ``block_bytes``: of a file, this much is one task's share."""
    id_type = index.schema["page_id"].dataType.simpleString()
    # index rows are tiny, so the records' bytes, not the rows', tell how many tasks it takes
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = (index.select("file", "offset", "length", F.floor(F.col("offset") / block_bytes).alias("_block"))
             .repartition(total // block_bytes + 1, "file", "_block").sortWithinPartitions("file", "offset"))

    def ranges(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        now: list[tuple] = []
        for file, offset, length, _ in rows:
            if now and (file != now[0][0] or offset - (now[-1][1] + now[-1][2]) > gap_bytes
                        or offset + length - now[0][1] > range_bytes):
                yield now
                now = []
            now.append((file, offset, length))
        if now:
            yield now

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        source, opened = None, None
        for group in ranges(rows):
            if opened != group[0][0]:
                if source is not None:
                    source.close()
                source, opened = store.open_input_file(f"{root}/{group[0][0]}"), group[0][0]
            begin = group[0][1]
            data = memoryview(source.read_at(group[-1][1] + group[-1][2] - begin, begin))
            found = []
            for _, offset, length in group:
                r = parse_record(gzip.decompress(data[offset - begin:offset - begin + length]))
                digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                if r["payload"] is not None and (digest != base32_sha1(r["payload"]) or len(r["payload"]) != r["payload_bytes"]):
                    raise ValueError(f"damaged record in {opened} at {offset}")
                page, first, url = (None if (x := r.get(k)) is None else _unline(x)
                                    for k in ("X-Page-Id", "X-Refers-To-Page-Id", "WARC-Target-URI"))
                found.append((page, url, r["WARC-Type"], r["payload"], r["payload_bytes"], digest, first))
            kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
            names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
        if source is not None:
            source.close()

    df = dealt.mapInArrow(read, RECORDS.format(id="string"))
    return df.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def archive_folder(spark: SparkSession) -> str:
    return shared_path(spark, "warc")
