"""WARC archives, index first.

Writing: each task appends records, one gzip member each, to archive files in the shared folder and returns an index row for
each record (archive, offset, length, URL, payload digest). An archive's name has a random part, and only rows of tasks that
succeeded reach the index, so a repeated task leaves at most a file that no index names. Archives are rolled at
`archive_bytes`.

Of records with equal payloads of at least `revisit_bytes` bytes, that with the largest id is a response and the others are
revisits, which carry no payload. Which payloads repeat is found from digests alone; only the table of repeated digests
meets the pages.

Reading: the index rows wanted are grouped by archive and `read_bytes` of it, sorted by offset; ranges closer than `gap`
bytes are read at once, then cut into records, whose payload digests are verified. How many tasks read follows the bytes
wanted, not the few bytes of the index rows.

Files are opened through pyarrow's file systems by URI, so the shared folder may be local, HDFS or an object store.

Edge cases: a null page is an empty payload; rows with a null id are responses with an empty id and are read back as null;
equal payloads with equal largest ids are all responses; an empty table writes no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import new_path, write_table


@dataclass(frozen=True)
class WarcConfig:
    revisit_bytes: int = 1000
    archive_bytes: int = 64 << 20
    read_bytes: int = 4 << 20
    gap: int = 64 << 10
    #: Reading tasks are no more than this, so that the scheduler holds them; beyond it a task reads several parts.
    most_tasks: int = 100_000
    level: int = 3
    #: The date of all records, so that equal pages give equal archives.
    date: str = "2024-01-01T00:00:00Z"


INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, archive string, offset long, length long"


def _record_id(page_id: int | None) -> str:
    return f"<urn:lathework:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    number = record_id.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, cfg: WarcConfig) -> bytes:
    """One WARC record, uncompressed."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = "".join((url or "").split())
    reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = reply if revisit else reply + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {cfg.date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of one uncompressed record, and what follows the HTTP headers of its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    n = int(headers["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("a record is cut short")
    return headers, rest[:n].partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Writes the archives and returns their index (columns of INDEX), itself written to the shared folder."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    long_ = F.octet_length("html") >= cfg.revisit_bytes
    repeated = rows.filter(long_).select(F.sha1("html").alias("digest"), "page_id").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null")
    repeated = write_table(repeated.select("digest", "keeper"), "warc-repeated")
    if repeated.limit(1).count():
        # Short pages have keys of their own that match nothing, so they don't meet in one task.
        own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
        rows = rows.withColumn("digest", F.when(long_, F.sha1("html")).otherwise(own)).join(repeated, "digest", "left").select("page_id", "url", "html", "keeper")
    else:
        rows = rows.withColumn("keeper", F.lit(None).cast("long"))
    folder = new_path(spark, "warc")
    uri = folder if "://" in folder or folder.startswith("file:") else "file://" + folder
    store_uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(store_uri)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for page_id, url, page, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = page.encode("utf-8", "surrogatepass")
                    revisit = keeper is not None and keeper != page_id
                    if out is None or at >= cfg.archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    packer = zlib.compressobj(cfg.level, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, payload, keeper, revisit, cfg)) + packer.flush()
                    out.write(member)
                    found.append((page_id, url, hashlib.sha1(payload).hexdigest(), len(payload), "revisit" if revisit else "response", keeper if revisit else None, name, at, len(member)))
                    at += len(member)
                columns = list(zip(*found)) or [[]] * 9
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.strip().split(" ")[0] for x in INDEX.split(",")])
        finally:
            if out is not None:
                out.close()

    index = write_table(rows.mapInArrow(run, INDEX), "warc-index")
    return index.withColumn("archive", F.concat(F.lit(store_uri + "/"), "archive"))


def read_records(index: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Reads the records of the index rows given: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    wanted = index.select("archive", F.floor(F.col("offset") / cfg.read_bytes).alias("part"), "offset", "length")

    def run(pdf):
        import pandas as pd

        store, path = fs.FileSystem.from_uri(pdf["archive"].iloc[0])
        ranges = sorted(zip(pdf["offset"].tolist(), pdf["length"].tolist()))
        out = []
        with store.open_input_file(path) as source:
            i = 0
            while i < len(ranges):
                start, stop, j = ranges[i][0], sum(ranges[i]), i + 1
                while j < len(ranges) and ranges[j][0] - stop <= cfg.gap:
                    stop, j = max(stop, sum(ranges[j])), j + 1
                data = source.read_at(stop - start, start)
                for offset, length in ranges[i:j]:
                    headers, body = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"payload digest differs at {offset} of {path}")
                    refers = _page_of(headers["WARC-Refers-To"]) if revisit else None
                    out.append((_page_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"], refers, int(headers["X-Payload-Length"]), digest, None if revisit else body))
                i = j
        frame = pd.DataFrame(out, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        return frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = min(cfg.most_tasks, -(-total // cfg.read_bytes) or 1)
    return wanted.repartition(tasks, "archive", "part").groupBy("archive", "part").applyInPandas(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Writes the archives and reads every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_records(write_archives(pages, cfg), cfg).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip_sql(cfg: WarcConfig = WarcConfig()) -> str:
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= {cfg.revisit_bytes} THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM q"""
