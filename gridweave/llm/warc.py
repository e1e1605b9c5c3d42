"""WARC archives: a writer of whole-file gzip streams, their normaliser, and a reader by index.

Some archives are one gzip member from end to end, so no record can be read without inflating all before it.
The normaliser inflates such a stream once, in pieces, rewrites every record as a gzip member of its own,
and writes a sidecar index with each record's offset and length in the new file.

Archives are rows (archive, content, index) of a table: Spark's committer writes them, and any store Spark
can reach may hold them; each row holds the bytes of one .warc.gz file and of its index file (one JSON object a line).
export() writes them out as such files, which any WARC tool opens, and read_files() reads files of that kind, monolithic or not.
Every archive begins with a warcinfo record; records that are not responses or revisits are kept and indexed, but give no row.

Of records with equal payloads of at least `min_payload` bytes, the one with the largest id is a response and the
others are revisits that refer to it; smaller payloads are always responses. A revisit keeps the HTTP header, so the size of the full
payload stays known, and the digest. A null payload counts as empty, a null url gives no target, a row whose id is null is a response, rows
that repeat the largest id are all responses. An empty table gives no archives. Columns other than the three named are not read.
Digests that many pages share are resolved by broadcast (heavy.py), so no task gathers one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, read_table
from .heavy import lookup

#: Payload bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
PIECE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(record) -> str:
    return f"<urn:gridweave:page:{record}>"


def record_bytes(record_id, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(record_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_bytes(name: str, date: str = DATE) -> bytes:
    """The warcinfo record that begins an archive."""
    block = b"software: gridweave\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:gridweave:archive:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}.warc.gz", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def inflate(pieces):
    """Inflates a stream of one or more gzip members, piece by piece."""
    machine = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            yield machine.decompress(piece)
            piece = machine.unused_data
            if machine.eof:
                machine = zlib.decompressobj(31)
            else:
                break


def records(stream):
    """Yields (header fields, whole record) from pieces of an uncompressed archive; holds one record at a time."""
    held = bytearray()
    need = None
    for piece in stream:
        held += piece
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                fields = _fields(bytes(held[:at]))
                need = at + 4 + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield fields, bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"the archive ends within a record, after {len(held)} bytes of it")


def normalise(content: bytes, level: int = 4) -> tuple[bytes, bytes]:
    """(archive with a member for each record, index) of a gzip stream of records."""
    out, index = bytearray(), []
    view = memoryview(content)
    for fields, record in records(inflate(bytes(view[i : i + PIECE]) for i in range(0, len(view), PIECE))):
        machine = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = machine.compress(record) + machine.flush()
        index.append(json.dumps({"id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"), "offset": len(out), "length": len(member)}))
        out += member
    return bytes(out), "\n".join(index).encode()


def _monolithic(date: str):
    def run(batches):
        base, seq, machine, parts, size = TaskContext.get().partitionId() << 24, 0, None, [], 0

        def closed():
            parts.append(machine.flush())
            return pa.RecordBatch.from_pydict({"archive": [base + seq], "content": [b"".join(parts)]})

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if machine is None:
                    machine = zlib.compressobj(1, zlib.DEFLATED, 31)
                    parts.append(machine.compress(info_bytes(str(base + seq), date)))
                payload = (html or "").encode()
                parts.append(machine.compress(record_bytes(page, url, payload, refers, date)))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    machine, parts, size, seq = None, [], 0, seq + 1
        if machine:
            yield closed()

    return run


def _normaliser(batches):
    for batch in batches:
        for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if content:
                new, index = normalise(content)
                yield pa.RecordBatch.from_pydict({"archive": pa.array([archive], pa.int64()), "content": [new], "index": [index]})


def _number(name: str | None):
    text = (name or "").removeprefix("<urn:gridweave:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def read_record(content: bytes, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record header, HTTP header, payload) of one member."""
    record = zlib.decompress(content[offset : offset + length], 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, _fields(http), payload


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive long, offset long, length long"


def _reader(batches):
    for batch in batches:
        for archive, content, index in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            rows = []
            for line in index.decode().splitlines():
                entry = json.loads(line)
                if entry["type"] not in ("response", "revisit"):
                    continue
                fields, http, payload = read_record(content, entry["offset"], entry["length"])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"record {entry['id']}: payload and digest differ")
                rows.append((_number(fields["warc-record-id"]), int(http["content-length"]), digest, fields["warc-type"], _number(fields.get("warc-refers-to")), fields.get("warc-target-uri"), archive, entry["offset"], entry["length"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])


def with_revisits(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page, url, html, refers_to): refers_to is null for responses. Only (id, digest) pairs are grouped."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= min_payload, F.sha1(F.col("html").cast("binary")))
    keyed = materialise(rows.select("page", digest.alias("digest")).where("digest is not null"), "digests")
    shared = keyed.groupBy("digest").agg(F.max("page").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = lookup(keyed, materialise(shared, "shared"), "digest").where("page < refers_to").distinct()
    named = rows.where("page is not null").withColumn("digest", digest)
    joined = named.join(revisits, ["page", "digest"], "left").select("page", "url", "html", "refers_to")
    return joined.unionByName(rows.where("page is null").select("*", F.lit(None).cast("long").alias("refers_to")))


def write_monolithic(rows: DataFrame, date: str = DATE) -> DataFrame:
    """(archive, content): whole-file gzip streams of the rows of with_revisits(). date: of all records."""
    return rows.mapInArrow(_monolithic(date), "archive long, content binary")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(archive, content, index) of a table (archive, content); null or empty contents give nothing."""
    return archives.select("archive", "content").mapInArrow(_normaliser, "archive long, content binary, index binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record, each inflated from its own member."""
    return archives.select("archive", "content", "index").mapInArrow(_reader, _READ)


def _exporter(folder: str):
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names = []
            for archive, content, index in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for end, data in ((".warc.gz", content), (".index.jsonl", index)):
                    path = os.path.join(root, f"{archive}{end}")
                    own = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
                    with store.open_output_stream(own) as out:
                        out.write(data)
                    store.move(own, path)  # a second attempt writes the same bytes
                names.append(f"{archive}.warc.gz")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], ["archive", "file"])

    return run


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as <archive>.warc.gz beside its <archive>.index.jsonl; (archive, file). folder: a URI that all executors reach."""
    return materialise(archives.select("archive", "content", "index").mapInArrow(_exporter(folder), "archive long, file string"), "exported")


def read_files(spark: SparkSession, paths: str) -> DataFrame:
    """(archive, content, index, path): files of records, gzip members or one stream, normalised. A file must fit a task."""
    files = spark.read.format("binaryFile").load(paths).select(F.xxhash64("path").alias("archive"), "path", "content")
    files = files.where("length(content) > 0")
    return normalise_archives(files).join(files.select("archive", "path"), "archive")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_revisits(read_table(spark, sf_dir, "pages"))
    archives = materialise(normalise_archives(write_monolithic(rows)), "archives")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM w
"""
