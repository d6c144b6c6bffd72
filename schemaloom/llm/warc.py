"""Operator 1, WARC: from archives of one gzip stream to archives of one member per record.

``write_monoliths`` writes pages as WARC records into whole-file gzip streams. ``normalise``
inflates each stream once, front to back, rewrites every record as its own gzip member, turns
records whose payload another record holds into revisits, and writes a sidecar offset index beside
the archive. ``read_back`` reads records through the index, member by member, and checks payloads
against their digests.

Archives are in the shared folder; a file is written under a name of the attempt and then moved,
so a repeated task replaces it whole. An archive is closed at ``ARCHIVE_BYTES`` of payload, so
what one task handles is bounded whatever the partitions are. Pages themselves are never shuffled:
the decision which record stays a response moves digests and numbers only, and the places of a
digest that many pages share are joined to one row.

Defined results: a null html is an empty payload; a null url has no target header; line ends in a
url are escaped. Payloads under 1000 bytes are always responses. Among rows with the same page_id
and payload, the last written is the response. A null page_id is carried as null. An empty table
gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_batches, stored, utf8

LEAST_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
LEVEL = 1
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Output:
    """A file that appears under its name only when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = _place(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        self.file = self.fs.open_output_stream(self.own, compression=None)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.own, self.path)


def record(kind: str, headers: dict[str, object], payload: bytes) -> bytes:
    """A response holds an HTTP message with the payload; a revisit only the HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload
    lines = [f"WARC-Type: {kind}"] + [f"{k}: {v}" for k, v in headers.items() if v is not None] + ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a whole-file gzip stream, inflated once as the chunks come."""
    inflate, held, need = zlib.decompressobj(31), bytearray(), 0
    for chunk in chunks:
        while chunk:
            held += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        while len(held) > need:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            size = next(int(x[15:]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
            need = end + 4 + size + 4
            if len(held) < need:
                need -= 1
                break
            yield parse(bytes(held[:need]))
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def _monoliths(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    part, k, out, rows, size = TaskContext.get().partitionId(), 0, None, [], 0

    def close():
        nonlocal out, rows, k
        out.write(deflate.flush())
        out.close()
        done, rows, out, k = rows, [], None, k + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["page_id", "archive", "seq", "digest", "payload_bytes"])

    for batch in small_batches(batches):
        for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), utf8(batch.column("html"))):
            if out is None:
                name, size, deflate = f"part-{part:06d}-{k:04d}.warc.gz", 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out = _Output(f"{folder}/monolith/{name}")
            payload = html or b""
            digest = hashlib.sha1(payload).hexdigest()
            headers = {"WARC-Record-ID": f"<urn:warc:{name}:{len(rows)}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": url and url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Page-ID": page, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": len(payload)}
            out.write(deflate.compress(record("response", headers, payload)))
            rows.append((page, name, len(rows), digest, len(payload)))
            size += len(payload)
            if size >= ARCHIVE_BYTES:
                yield close()
    if out is not None:
        yield close()


def write_monoliths(pages: DataFrame, folder: str) -> DataFrame:
    """The manifest: page_id, archive, seq in it, digest, payload_bytes."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return stored(pages.mapInArrow(partial(_monoliths, folder=folder), "page_id long, archive string, seq long, digest string, payload_bytes long"), "manifest")


def decide(manifest: DataFrame) -> DataFrame:
    """archive, seq, revisit, refers_to.

    Small payloads, of which very many may be equal, have no part in the join; a large one that very many
    pages have meets a table of its own, so that adaptive execution can split it.
    """
    place = F.struct("page_id", "archive", "seq")
    large = F.col("payload_bytes") >= LEAST_BYTES
    shared = manifest.where(large).groupBy("digest").agg(F.max(place).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    both = manifest.where(large).join(stored(shared, "shared"), "digest", "left")
    revisit = F.coalesce(F.col("keep") != place, F.lit(False))
    decided = both.select("archive", "seq", revisit.alias("revisit"), F.when(revisit, F.col("keep.page_id")).alias("refers_to"))
    return decided.unionByName(manifest.where(~large).select("archive", "seq", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to")))


def _chunks(uri: str) -> Iterator[bytes]:
    where, path = _place(uri)
    with where.open_input_stream(path, compression=None) as f:
        while data := f.read(CHUNK):
            yield data


def _normalise(table: pa.Table, folder: str) -> pa.Table:
    table = table.sort_by("seq")
    name, refers = table.column("archive")[0].as_py(), dict(zip(table.column("seq").to_pylist(), zip(table.column("revisit").to_pylist(), table.column("refers_to").to_pylist())))
    out, index, at = _Output(f"{folder}/members/{name}"), [], 0
    for seq, (headers, payload) in enumerate(records(_chunks(f"{folder}/monolith/{name}"))):
        revisit, other = refers[seq]
        kept = {k: v for k, v in headers.items() if k not in ("WARC-Type", "Content-Type", "Content-Length")}
        data = record("revisit", kept | {"WARC-Refers-To": other, "WARC-Profile": PROFILE}, b"") if revisit else record("response", kept, payload)
        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = deflate.compress(data) + deflate.flush()
        out.write(member)
        index.append((name, at, len(member), "revisit" if revisit else "response"))
        at += len(member)
    out.close()
    side = _Output(f"{folder}/members/{name}.idx")
    side.write("".join(json.dumps(x[1:]) + "\n" for x in index).encode())
    side.close()
    return pa.table([pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["archive", "position", "size", "kind"])


def _by_archive(rows: DataFrame):
    """A partition for each archive: its rows are few, but its file isn't small."""
    archives = rows.select("archive").distinct().count()
    return rows.repartition(max(1, archives), "archive").groupBy("archive")


def normalise(decisions: DataFrame, folder: str) -> DataFrame:
    """The index of all archives: archive, position, size, kind. One task's group is one archive."""
    return stored(_by_archive(decisions).applyInArrow(lambda t: _normalise(t, folder), "archive string, position long, size long, kind string"), "index")


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, position long"


def _read(table: pa.Table, folder: str) -> pa.Table:
    table = table.sort_by("position")
    name, out = table.column("archive")[0].as_py(), []
    where, path = _place(f"{folder}/members/{name}")
    with where.open_input_file(path) as f:
        for at, size in zip(table.column("position").to_pylist(), table.column("size").to_pylist()):
            f.seek(at)
            headers, payload = parse(zlib.decompress(f.read(size), 31))
            digest, n, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Payload-Length"]), headers["WARC-Type"]
            if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"{name} at {at}: the payload doesn't match its digest")
            page, refers = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To")
            out.append((page and int(page), n, digest, kind, refers and int(refers), name, at))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in RESULT.split(", ")])


def read_back(index: DataFrame, folder: str) -> DataFrame:
    return _by_archive(index).applyInArrow(lambda t: _read(t, folder), RESULT)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write_monoliths(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_back(normalise(decide(manifest), folder), folder).drop("archive", "position")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS keep FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to FROM k
"""
