"""WARC archives with revisit records for repeated payloads.

Payload digests are resolved on headers alone (page id, digest, size), by a
shuffle on the digest; only then are the pages written.  Of equal payloads one
page keeps its response record, the others become revisit records that refer to
it and carry no payload.  Every record is a gzip member of its own, so archives
can be read from any record on.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.scratch import Scratch

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LEVEL = 4
_READ = 1 << 20


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers of the pages that become revisits: uid, ref_id and ref_uid of the response they refer to.

    ``pages``: uid, page_id, digest (hex SHA-1) and size.  The largest page_id
    of equal payloads is the response (among repeated rows, the largest uid; a
    page without an id only if none has one).
    """
    heads = pages.select("uid", "page_id", "digest", "size").where(F.col("size") >= min_bytes)
    first = (heads.groupBy("digest", "size").agg(F.max(F.struct("page_id", "uid")).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("digest", "size", F.col("r.page_id").alias("ref_id"), F.col("r.uid").alias("ref_uid")))
    return heads.join(first, ["digest", "size"]).where("uid <> ref_uid").select("uid", "ref_id", "ref_uid")


def _clean(s: str | None) -> str:
    """A header value: no control characters or blanks."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in s or "")


def _name(page_id: int | None, uid: int) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}.{uid}>"


def record(page_id: int | None, uid: int, url: str | None, digest: str, size: int, payload: bytes | None, ref: tuple[int | None, int] | None, date: str) -> bytes:
    """One record as a gzip member; ``ref`` names the response that a revisit refers to."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if ref else 'response'}", f"WARC-Record-ID: {_name(page_id, uid)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if ref:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(*ref)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _write(path: str, date: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        uri = f"{path}/pages-{ctx.partitionId():08d}.warc.gz"
        fs, name = pafs.FileSystem.from_uri(uri)
        part = f"{os.path.dirname(name)}/_{os.path.basename(name)}.{ctx.taskAttemptId()}"
        out, n = None, 0
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                for r in b.slice(lo, 64).to_pylist():
                    if out is None:
                        fs.create_dir(os.path.dirname(name), recursive=True)
                        out = fs.open_output_stream(part, compression=None)
                    ref = None if r["ref_uid"] is None else (r["ref_id"], r["ref_uid"])
                    payload = None if ref else (r["html"] or "").encode()
                    out.write(record(r["page_id"], r["uid"], r["url"], base32(r["digest"]), r["size"], payload, ref, date))
                    n += 1
        if out is not None:
            out.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_pylist([{"uri": uri, "records": n}])
    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id long, url, html) as archives under ``path``, which all executors reach; returns uri, records.

    A null html is an empty payload; a null url leaves the target out.  Equal
    payloads of at least ``min_bytes`` bytes share one response.  Other columns
    are ignored.  ``pages`` must give the same rows in the same order when it
    is read again (a table does): row numbers tell repeated rows apart.
    """
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    x = x.withColumn("uid", F.monotonically_increasing_id()).withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    x = x.join(resolve(x, min_bytes), "uid", "left").withColumn("html", F.when(F.col("ref_uid").isNull(), F.col("html")))
    return x.select("uid", "page_id", "url", "html", "digest", "size", "ref_id", "ref_uid").mapInArrow(_write(path, date), "uri string, records long")


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive; holds one record at a time."""
    fs, name = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(name, compression=None) as f:
        data = f.read(_READ)
        while data:
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                if not data:
                    data = f.read(_READ)
                    if not data:
                        raise ValueError(f"archive ends within a record: {uri}")
                parts.append(z.decompress(data))
                data = z.unused_data
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[:int(fields["Content-Length"])]
            data = data or f.read(_READ)


def _page(name: str) -> int | None:
    p = name.removeprefix("<urn:x-page:").split(".")[0]
    return None if p == "none" else int(p)


_FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column("uri").to_pylist():
            rows: list[dict] = []
            for h, block in records(uri):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
                if kind == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != digest or size != len(payload):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't match its digest")
                ref = h.get("WARC-Refers-To")
                rows.append({"page_id": _page(h["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
                             "refers_to": _page(ref) if ref else None, "url": h.get("WARC-Target-URI")})
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))


def read_archives(archives: DataFrame) -> DataFrame:
    """Per record of the archives (uri): page_id, payload size and digest, type, the page it refers to, url.

    Responses are checked against their digest; a mismatch raises.
    """
    n = max(1, min(archives.count(), 1 << 16))
    return archives.select("uri").repartition(n, "uri").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` under the shared folder and read the archives back."""
    scratch = Scratch(pages.sparkSession, "warc")
    files = scratch.keep(write_archives(pages, scratch.at("archives"), min_bytes), "files")
    return read_archives(files)
